"""Rows without an id, and rows with very many copies: dealt evenly, and the same in every run."""

from collections import Counter

from pyspark.sql import functions as F

from stateloom.llm import minhash, mixing, sharding

TREE = {"r0": {"k0": {0: 1.0, 1: 1.0}}, "r1": {"k0": {2: 1.0}}}


def without_ids(spark, n, texts="differ"):
    text = F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")) if texts == "differ" else F.lit("the same few words")
    return spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"), (F.col("id") % 3).alias("lang"))


def test_training_order_of_rows_without_ids_does_not_depend_on_their_order(spark):
    rows = without_ids(spark, 1200).withColumn("text", F.when(F.col("lang") == 0, F.concat("text", F.lit(" a b c"))).otherwise(F.col("text")))
    rows = rows.unionByName(rows.limit(40).withColumn("source", F.lit("t")))
    results = []
    for seed in (1, 2):
        shuffled = rows.repartition(3 + seed).orderBy(F.rand(seed))
        made = mixing.training_order(shuffled).collect()
        results.append([(r["_position"], r.text, r.source, r.lang) for r in sorted(made, key=lambda r: (r["_position"], r.text, r.source, r.lang))])
    assert results[0] == results[1] and len(results[0]) > 1000


def test_rows_without_ids_fill_their_buckets_evenly(spark):
    rows = without_ids(spark, 100_000)
    placed = mixing._placed(rows, "doc_id", "text", "source", (5, 2, 1), 3, mixing.SCHEDULES, ())
    counts = [r["count"] for r in placed.groupBy(F.substring("order", 1, 2)).count().collect()]
    assert len(counts) == 256 and max(counts) < 2 * 100_000 / 256


def test_copies_are_placed_by_count(spark):
    """A hundred thousand equal rows meet in no window, and take the places that a window would give them."""
    rows = without_ids(spark, 20_000, "same").withColumn("lang", F.lit(0)).unionByName(without_ids(spark, 3000))
    key = F.concat_ws("/", "order", F.col("rest").cast("string"), "src")
    keyed = rows.select("*", F.lit("o").alias("order"), F.xxhash64("text", "lang").alias("rest"), F.lit("s").alias("src")).withColumn("key", key)
    assert len(mixing._copied(keyed)) == 1
    mixed = mixing.mix_to_targets(rows, weights=(1,))
    passes = sorted(p for r in mixed.collect() for p in r.positions)
    n_words = 20_000 * 4 + 3000 * 2
    assert mixed.count() == 23_000 and mixed.agg(F.sum("taken")).first()[0] == n_words
    # All middles differ by at least half of the least size, so no place was given twice.
    middles = [p * p for p in passes]
    assert len(set(passes)) == len(passes) == 23_000 and middles == sorted(middles)


def test_equal_rows_get_gapless_slots_in_bounded_runs(spark):
    n = 100_000
    rows = without_ids(spark, n, "same").unionByName(without_ids(spark, 500))
    made = sharding.hash_tree_shards(rows, TREE, run=256).collect()
    assert len(made) == n + 500
    slots = {}
    for r in made:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.hash_tree_shards(rows.repartition(7), TREE, run=256).collect()
    assert Counter(made) == Counter(again)


def test_repeated_rows_fold_before_their_texts_are_joined(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(5, text + " more"), (6, "alone and short")], "doc_id long, text string"))
    found = minhash.near_duplicates(rows).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == {(None, 5): 3000, (5, 5): 1, (6, 6): 1}
