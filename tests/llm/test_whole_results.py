"""No text is lost, no link is decided wrongly, no name clashes: cases that once went wrong, and whole results."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as vocab
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from stateloom.llm import chunk_dedup, embeddings, fertility, line_dedup, minhash, mixing, packing, secret_scan, sharding
from stateloom.llm._arrays import text_slices, word_hashes
from stateloom.llm._scratch import Scratch
from stateloom.llm.queries import GROWN_TREE, SHARD_TREE

FILES = vocab.path("byte_bpe_50k.json"), vocab.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_lines_that_collide_in_polynomial_hashes_differ(spark):
    one, two = thue_morse(4096), thue_morse(4096, "b", "a")
    df = spark.createDataFrame([(1, f"x\n{one}\ny"), (2, f"x\n{two}\ny"), (3, f"x\n{one}\ny")], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(df).collect()} == {1: (f"x\n{one}\ny", 0), 2: (f"x\n{two}\ny", 0), 3: ("", 3)}


def test_long_words_that_collide_in_polynomial_hashes_differ(spark):
    import pyarrow as pa

    words = [thue_morse(4096), thue_morse(4096, "b", "a"), thue_morse(4096).upper()]
    ((_, data, offsets),) = text_slices(pa.array([" ".join(words)]))
    hashes, _ = word_hashes(data, offsets, lower=True)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_chunks_of_rows_that_share_an_id(spark):
    rng = random.Random(21)
    p, q, r = (noise(rng, 100) for _ in range(3))
    rows = [(0, p), (1, p), (1, q), (None, f"{r} {p}"), (None, f"{p} {q}"), (None, f"{p} {q}"), (2, "é" * 50), (3, "é" * 50), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = lambda data: brute.gear_chunks(data, chunk_dedup._GEAR.tolist(), 31, 16, 512)
    spans = chunk_dedup.repeated_spans(df)
    hashes = {r.h: r.text for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    got = {(r.doc_id, hashes[r.text_hash], r.start, r.length, r.n_chunks, tuple(r.first_ids), r.whole, r.short) for r in spans.collect()}
    assert got == brute.repeated_spans(rows, cut, 80)
    for r in spans.collect():
        assert r.start + r.length <= len(hashes[r.text_hash].encode())
    # What is cut stands somewhere else: all pieces of all texts are still there.
    left = [t for t in (r.text for r in chunk_dedup.remove_spans(df.withColumn("cuts", F.lit(1)), spans).collect()) if t]
    assert sum(q in t for t in left) >= 1 or q in "".join(left)
    before = {c for _, t in rows for c in cut((t or "").encode())}
    assert before <= {c for t in left for c in cut(t.encode())} | {c for c in before if any(c in t.encode() for t in left)}


def test_spans_of_the_documents_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    cut = lambda data: brute.gear_chunks(data, chunk_dedup._GEAR.tolist(), 31, 16, 512)
    text = dict(rows)
    spans = chunk_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, text[r.doc_id], r.start, r.length, r.n_chunks, tuple(r.first_ids), r.whole, r.short) for r in spans} == brute.repeated_spans(rows, cut, 80)


def test_links_are_decided_in_integers():
    common, union = 758_687, 892_573
    extra = union - common
    x = np.arange(common + extra // 2, dtype=np.uint64)
    y = np.concatenate([np.arange(common, dtype=np.uint64), np.arange(extra - extra // 2, dtype=np.uint64) + np.uint64(10**9)])
    counts = minhash.shared_counts([x, y])
    assert counts[0, 1] == common
    for percent in (84, 85, 86):
        assert minhash.similar(counts, np.array([len(x), len(y)]), percent)[0, 1] == (100 * common >= percent * union)


@pytest.mark.parametrize("options", [{"block": 8}, {"block_bytes": 2000}, {"block": 8, "hub_rounds": 1}])
def test_near_copies_of_many_groups_in_small_blocks(spark, options):
    rng = random.Random(31)
    texts = {}
    for g in range(3):
        base = noise(rng, 80).split()
        for _ in range(50):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = minhash.near_duplicates(df, width=3, percent=85, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates(texts, 3, 85)


def test_vectors_out_of_the_range_of_squares_link(spark):
    rows = [(1, [1e200] * 4), (2, [1e-200] * 4), (3, [1.0] * 4), (4, [-1e300] * 4), (5, [5e-324] * 4), (6, [0.0, 0.0, 0.0, -0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), 5: (3, 1, False), 4: (0, 4, True), 6: (0, 6, True)}


def test_a_cosine_depends_on_its_two_rows_alone():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    a, b = np.triu_indices(300, 1)
    whole = embeddings.cosines(x, a, b)
    for k in rng.integers(0, len(a), 200):
        pair = embeddings.cosines(x[[a[k], b[k]]].copy(), np.array([0]), np.array([1]))
        assert pair[0] == whole[k] == embeddings.cosines(x, a, b, values=64)[k]


def test_vectors_that_share_an_id_or_repeat(spark):
    u, v = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(1, u), (1, u), (1, v), (2, v), (3, u), (None, u)], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embeddings.near_duplicate_vectors(df).collect())
    assert got == [("1", 1, "1"), ("1", 1, "1"), ("1", 1, "1"), ("2", 1, "1"), ("3", 1, "1"), ("None", 0, "None")]


def test_planted_vectors_are_found(spark):
    """Dense groups of near copies at all angles around the threshold, over several block sizes."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(150, 32))
    x = np.concatenate([centres[rng.integers(0, 150, 1500)] + rng.normal(size=(1500, 32)) * rng.choice([0.02, 0.15, 0.2, 0.3], (1500, 1)), rng.normal(size=(500, 32))])
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.95
    np.fill_diagonal(links, False)
    for block in (16, 1024):
        got = {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(df, block=block).collect()}
        found = np.array([got[i] for i in range(2000)])
        assert (found <= links.sum(axis=1)).all()
        assert found.sum() >= 0.99 * links.sum() > 4000


def test_packing_deals_equal_rows_over_groups(spark):
    rows = [(None, None)] * 500 + [(1, "a b c")] * 100 + [(2, "d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    packed = packing.pack_documents(df, *FILES, vocab.PATTERN, capacity=64, group_rows=64).collect()
    assert len(packed) == 601 and sum(r.doc_id is None for r in packed) == 500
    assert len({r.sequence_id >> 32 for r in packed if r.doc_id is None}) > 3
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64


def test_secrets_of_a_text_with_very_many(spark):
    rng = random.Random(41)
    text = " ".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(10, 22))) for _ in range(30_000))
    rows = [(1, text), (2, f"🙂{text[:3000]} token=abcdefghijklmnop"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).withColumn("lang", F.lit("en"))
    for r in secret_scan.scan_secrets(df).collect():
        base = brute.secrets(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == base


def test_a_language_named_like_a_script_selects_no_band():
    vocabularies = fertility.vocabularies(vocab.path("piece_bpe_32k.model"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    at = list(fertility.FIELDS).index("band")
    for lang in ("NONE", "OTHER", "HAN", "xx", None):
        assert fertility.measured("plain words", lang, vocabularies, fertility.BANDS, 8)[at] == "LATIN"
    assert fertility.measured("plain words", "de", vocabularies, fertility.BANDS, 8)[at] == "de"


def test_each_measure_rejects_and_limits_can_be_fitted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    paths = vocab.path("piece_bpe_32k.model"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN
    measured = Scratch(spark, "test").keep(fertility.quality_rules(docs, *paths))
    rows = [r for r in measured.collect() if not r.base_failed]
    assert {r.kept for r in rows} == {True, False}
    for r in fertility.fit_lower_limits(measured, labels.where("quality = 1")).collect():
        assert abs(r.min_chars_per_token - fertility.BANDS[r.band].min_chars_per_token) < 0.05 and r.n <= 500
    text = next(t for i, t in docs.select("doc_id", "text").collect() if any(r.doc_id == i and r.kept for r in rows))
    v = fertility.vocabularies(*paths)
    at = {k: i for i, k in enumerate(fertility.FIELDS)}
    wide = fertility.Band(0.0, 99.0, 1.0, 0.0)
    judge = lambda **limits: fertility.measured(text, "en", v, {"en": wide._replace(**limits)}, 8)
    found = judge()
    per_token, share, entropy = (found[at[k]] for k in ("chars_per_token", "byte_share", "token_entropy"))
    assert found[at["kept"]]
    for limits in ({"min_chars_per_token": per_token + 2}, {"max_chars_per_token": per_token - 0.01}, {"max_byte_share": share - 0.01}, {"min_entropy": entropy + 0.01}):
        assert not judge(**limits)[at["kept"]]
    assert fertility.lower_limit(wide, 100) == -0.3


def test_the_tree_equals_a_plain_one(spark):
    tree = {"r0": {"k0": {0: 1.0, 1: 3.0}, "k1": {2: 0.5, 3: 1.0}}, "r1": {"k0": {4: 2.0, 5: 1.0}, "k1": {6: 1.0, 7: 1.0}}}
    ids = spark.range(-200, 800)
    for r in ids.select("id", sharding.shard_of(F.col("id"), tree).alias("s"), sharding.shard_of(F.col("id"), SHARD_TREE).alias("t")).collect():
        assert (r.s, r.t) == (brute.shard(r.id, tree), brute.shard(r.id, SHARD_TREE))
    nameless = spark.createDataFrame([(None, f"t{i}") for i in range(40)] + [(None, None)] * 3 + [(5, "x")], "doc_id long, text string")
    rows = sharding.hash_tree_shards(nameless, SHARD_TREE, GROWN_TREE, buckets=8).collect()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_mixing_equals_brute_force_and_takes_clashing_names(spark):
    clash = ["size", "source_size", "target", "taken", "positions", "_src", "_bucket", "_order", "_position", "row", "id", "src", "bucket", "order", "inside", "before", "_rank"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()]
    expected = {rows[k][0]: v for k, v in brute.mixed(rows).items()}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    wide = docs.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(clash)])
    got = mixing.mix_to_targets(wide).collect()
    assert len(got) == len(rows)
    source = {i: s for i, _, s in rows}
    for r in got:
        size, target, passes = expected[r.doc_id]
        assert r["size"] == size and r.target == pytest.approx(target) and r.taken == size * len(passes)
        schedule = mixing.SCHEDULES[names.index(source[r.doc_id]) % 3]
        assert r.positions == pytest.approx([brute.time_of(x / target, schedule) for x in passes], abs=1e-9)
    ordered = mixing.training_order(wide, position_col="at")
    assert ordered.columns == [*wide.columns, "at"]
    seen = ordered.collect()
    assert sorted((r.doc_id, r.at) for r in seen) == sorted((r.doc_id, p) for r in got for p in r.positions)
    assert all([r[c] for c in clash] == [f"v{i}" for i in range(len(clash))] for r in seen)


def test_null_ids_pass_every_operator(spark):
    rows = [(None, "some words of a text that is not short " * 3, "en", "s"), (None, None, None, None), (None, "x", "de", "t"), (7, "x", "de", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from stateloom.llm import token_counts

    quality = fertility.quality_rules(df, vocab.path("piece_bpe_32k.model"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN).collect()
    assert sorted(r.n_words for r in quality) == [0, 1, 1, 27]
    assert sorted(r.n_bytes for r in token_counts.token_counts(df, vocab.path("piece_bpe_32k.model")).collect()) == [0, 1, 1, 117]
    assert len(mixing.mix_to_targets(df).collect()) == len(packing.pack_documents(df, *FILES, vocab.PATTERN).collect()) == 4
    assert len(secret_scan.scan_secrets(df).collect()) == len(sharding.hash_tree_shards(df, SHARD_TREE).collect()) == 4


def test_near_copies_lose_no_text(spark):
    rng = random.Random(51)
    a, b, c, d = (noise(rng, 60) for _ in range(4))
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (1, a), (2, a), (None, c), (None, c), (None, d), (5, near), (6, ""), (6, ""), (7, None), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("row_key", F.lit(1))
    got = corpus_pipeline.near_copies(spark, df, SF)
    assert got.columns == df.columns
    expected = [(1, a), (1, b), (None, d), (5, near), (6, ""), (7, None), (None, None), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, expected))


def test_stages_keep_the_values_of_clashing_columns(spark):
    names = ["n_lines", "n_removed", "size", "target", "kept", "row", "key", "rank", "position", "stays", "_rank", "_position", "_row", "total", "removed"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[(F.col("doc_id") * 100 + i).alias(n) for i, n in enumerate(names)])
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = Scratch(spark, "test").keep(stage(spark, wide, SF))
        if i == 4:
            assert made.count() > 0
            break
        assert made.columns == wide.columns
        assert all(r[n] == r.doc_id * 100 + k for r in made.collect() for k, n in enumerate(names))
        wide = made


def test_pipeline_equals_plain_stages(spark):
    """The rows of run() against the stages one by one in plain Python, up to the placement of pieces."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILES[0])
    vocabularies = fertility.vocabularies(vocab.path("piece_bpe_32k.model"), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    good = {}
    for i, r in rows.items():
        n_words, _, _, _, _, failed = brute.quality_base(r.text)
        words = brute.WORD.findall(r.text or "")
        if failed or not words:
            continue
        pieces = [p for w in words for p in vocabularies.model.encode(w)]
        share = sum(vocabularies.model.is_byte(p) for p in pieces) / len(pieces)
        counts = np.unique(pieces, return_counts=True)[1] / len(pieces)
        entropy = -(counts * np.log2(counts)).sum()
        tokens = sum(len(vocabularies.ranks.encode_ordinary(" " + w)) for w in words)
        band = fertility.BANDS[r.lang]
        low = fertility.lower_limit(band, tokens)
        if low <= sum(map(len, words)) / tokens <= band.max_chars_per_token and share <= band.max_byte_share and entropy >= band.min_entropy:
            good[i] = r.text
    cut = {i: t for i, (t, _) in brute.line_dedup(list(good.items())).items() if brute.WORD.search(t)}
    unique = [i for i, (_, c) in brute.near_duplicates(cut, 5, 80).items() if i == c]
    mixed = brute.mixed([(i, cut[i], rows[i].source) for i in unique])
    expected = {}
    for k, (_, _, passes) in mixed.items():
        ids = whole.encode(cut[unique[k]], add_special_tokens=False).ids + [1]
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            key = (unique[k], start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))
            if passes:
                expected[key] = len(passes)
    got, ends = {}, {}
    for r in sorted(corpus_pipeline.run(spark, SF).collect(), key=lambda r: (r.sequence_id, r.offset)):
        key = (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)
        got[key] = got.get(key, 0) + 1
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert got == expected and max(ends.values()) <= 2048


def test_a_closed_scratch_is_gone(spark, tmp_path):
    import os

    with Scratch(spark, "closed") as scratch:
        scratch.keep(spark.range(3))
        folder = scratch.root.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
