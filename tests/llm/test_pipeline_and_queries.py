"""The registered queries against SQL, and the pipeline's stages on a small table."""

import duckdb
import pytest

import __spark_entry__
import brute
import corpus_pipeline
from stateloom.llm import mixing, queries
from stateloom.llm._scratch import with_rank

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, expected))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
        kept.append(docs)
    good, lines, unique, mixed, packed = kept
    texts = {r.doc_id: r.text for r in good.collect()}
    cut = {i: t for i, (t, _) in brute.line_dedup(list(texts.items())).items() if brute.WORD.search(t)}
    assert {r.doc_id: r.text for r in lines.collect()} == cut
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    groups = brute.near_duplicates(cut, 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in unique.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}


def test_stages_take_nulls_and_repeats(spark):
    rows = [(1, "a b c " * 20, "en", "s", 120), (1, "a b c " * 20, "en", "s", 120), (None, None, None, None, None), (2, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, SF).collect()
    assert corpus_pipeline.near_copies(spark, docs, SF).count() == 3


def test_sequences_follow_the_training_order(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = [r.doc_id for r in mixing.training_order(docs, partitions=3).collect()]
    # Stage 4 as written and reread; then not written, and written in many files.
    corpus_pipeline.mixture(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    mixing.training_order(docs, partitions=12).select(*docs.columns).write.option("maxRecordsPerFile", 7).parquet(str(tmp_path / "many"))
    for mixed in (spark.read.parquet(str(tmp_path / "mixed")), corpus_pipeline.mixture(spark, docs, SF), spark.read.parquet(str(tmp_path / "many"))):
        ranked = with_rank(mixed, "_rank").orderBy("_rank").collect()
        assert [r._rank for r in ranked] == list(range(len(order)))
        assert [r.doc_id for r in ranked] == order
        packed = corpus_pipeline.sequences(spark, mixed, SF).collect()
        first = [r.doc_id for r in sorted(packed, key=lambda r: r.sequence_id) if r.offset == 0 and r.start == 0]
        left = iter(order)
        assert all(d in left for d in first)  # the sequences begin with documents in their order
        shared = [(r.sequence_id, r.doc_id) for r in packed]
        assert len(order) > len(set(order)) and len(shared) == len(set(shared))


def test_mixing_query_ranks_every_pass(spark):
    rows = queries.queries()["op10_curriculum_mixing"](spark, SF).collect()
    order = [r.doc_id for r in mixing.training_order(spark.read.parquet(f"{SF}/documents.parquet"), partitions=3).collect()]
    listed = lambda text: [int(x) for x in text.split(",") if x]
    rows = [(r, listed(r.positions), listed(r.ranks)) for r in rows]
    assert any(len(p) > 1 for _, p, _ in rows) and any(not p for _, p, _ in rows)
    for r, positions, ranks in rows:
        assert len(ranks) == len(positions) and r.taken == r["size"] * len(positions)
        assert (r.first_position is None) == (not positions) and (not positions or int(r.first_position * 1e9) == positions[0])
    passes = sorted((k, p, r.doc_id) for r, positions, ranks in rows for k, p in zip(ranks, positions, strict=True))
    assert [k for k, _, _ in passes] == list(range(len(order)))
    assert [p for _, p, _ in passes] == sorted(p for _, p, _ in passes)
    assert [d for _, _, d in passes] == order
