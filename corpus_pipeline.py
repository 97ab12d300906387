"""A training corpus from raw documents: quality, lines, near copies, mixture, sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the
stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stateloom.llm import fertility, line_dedup, minhash, mixing, packing
from stateloom.llm._groups import fresh
from stateloom.llm._scratch import Scratch, with_rank


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep; a null or wordless text goes."""
    row = fresh("row", [*docs.columns, *fertility.FIELDS])
    judged = fertility.quality_rules(
        docs.withColumn(row, F.struct(*docs.columns)),
        vocab.path("piece_bpe_32k.model"),
        vocab.path("byte_bpe_multi_50k.tiktoken"),
        vocab.PATTERN,
        carry=(row,),
    )
    return judged.where("kept").select(f"{row}.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines repeated from earlier; a text that keeps no word goes."""
    counts = fresh("total", docs.columns), fresh("removed", docs.columns)
    cut = line_dedup.dedup_lines(docs, counts=counts).where(F.col("text").rlike(line_dedup.WORDLESS))
    texts = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return cut.select(*[texts.get(c, F.col(c)).alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near copies; five words, 0.8.

    Rows equal in id and text are one document; rows that share an id, or have none, and
    differ in text are judged each for itself.
    """
    key = fresh("key", docs.columns)
    found = minhash.near_duplicates(docs).groupBy(F.col("row_key").alias(key)).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    marked = Scratch(spark, "marked").keep(found.where("NOT stays OR n > 1"))
    keyed = docs.withColumn(key, minhash.row_key("doc_id", "text"))
    once = keyed.join(marked.select(key), key, "left_anti")
    again = keyed.join(marked.where("stays").select(key), key, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(again).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for every pass that their source's target takes."""
    return mixing.training_order(docs, position_col=fresh("position", docs.columns)).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of at most 2,048, numbered in training order.

    The training order is the order of the table that ``mixture`` was written to.
    """
    files = vocab.path("byte_bpe_50k.json"), vocab.path("byte_bpe_50k.tiktoken")
    rank = fresh("rank", docs.columns)
    return packing.pack_documents(with_rank(docs, rank), *files, vocab.PATTERN, order_col=rank)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Tokenisers and sketches have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        docs, path = scratch.table(made)
        scratch.drop(before)
        before = path
    return docs
