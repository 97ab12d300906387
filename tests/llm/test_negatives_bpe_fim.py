"""Hard negatives, byte-level BPE and fill-in-middle against brute force, the libraries and exact round trips."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers as vocab
import pytest
import tiktoken
from pyspark.sql import functions as F

from stateloom.llm import byte_bpe, fill_middle, negatives, queries

RANKS = vocab.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"


# Hard negatives


def brute_negatives(rows, is_anchor, low=80, high=100, k=5):
    able = []
    for place, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 1 << 62:
            able.append((place, i, label, q))
    out = []
    for place, i, label, q in able:
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, w)), j, other != label, p) for p, j, other, w in able if p != place and len(w) == len(q)]
        for s, j, _, _ in sorted(x for x in scored if not x[2])[:k]:
            fits = sorted(x for x in scored if x[2] and -low * s <= -100 * x[0] <= -high * s)[:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _, _) in enumerate(fits, 1)]
    return sorted(out)


def found_negatives(spark, rows, is_anchor, parts=3, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("key", F.lit(1)).withColumn("row", F.lit("x")).withColumn("cell", F.lit(2)).repartition(parts)
    return sorted(tuple(r) for r in negatives.hard_negatives(df, is_anchor, **options).collect())


@pytest.mark.parametrize("options", [{}, {"block": 64, "anchor_block": 3, "n_pivots": 5}, {"n_pivots": 1, "sample": 1}])
def test_negatives_equal_brute_force(spark, options):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(300):
        label = int(rng.integers(0, 6)) if i % 3 else 0  # label 0 has more than a third
        v = centres[label] + rng.standard_normal(12) * rng.choice([0.1, 0.6, 2.0])
        rows.append((i, (v / np.linalg.norm(v)).round(2).tolist(), label))
    got = found_negatives(spark, rows, F.col("vec_id") % 10 == 0, **options)
    assert got and got == brute_negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_odd_rows(spark):
    rng = random.Random(7)
    vector = lambda n=3: [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(n)]
    rows = [(i % 60, vector(), rng.choice([0, 0, 1, 2])) for i in range(120)]  # ids repeat, many ties
    rows += [(100 + i, vector(2), i % 2) for i in range(20)] + [(130 + i, [], i % 2) for i in range(6)]
    rows += [(None, vector(), 0), (200, None, 0), (201, vector(), None), (202, [1.0, None, 1.0], 1), (203, [math.nan, 1.0, 1.0], 1), (204, [math.inf, 1.0, 1.0], 1)]
    rows += [(210, [1e30, 1.0, 1.0], 1), (211, [1e6, -1e6, 3.0], 0), (212, [1e6, -1e6, 3.5], 1), (213, [1e6, -1e6, 2.5], 0), (214, [4e6, 4e6, 1.0], 0)]
    want = brute_negatives(rows, lambda i: i % 4 == 0 or i > 99)
    for parts in (1, 7):
        assert found_negatives(spark, rows, (F.col("vec_id") % 4 == 0) | (F.col("vec_id") > 99), parts, n_pivots=4) == want


def test_no_negatives_in_an_empty_table(spark):
    assert found_negatives(spark, [], F.col("vec_id") % 2 == 0) == []
    assert found_negatives(spark, [(1, [1.0], 0), (2, None, 1)], F.col("vec_id") == 1) == []


def test_brackets_hold_every_score():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((200, 16)) * 1000).astype(np.int64)
    norm = (x * x).sum(axis=1)
    pivots = negatives.choose_pivots([(v.astype("<i4").tobytes(), int(n)) for v, n in zip(x[:50], norm)], int(norm.max()), 8)
    block = lambda is_anchor: negatives.Block(np.arange(200), np.arange(200), np.zeros(200), x, pivots.distances(x, norm, is_anchor), norm)
    least, largest = negatives._bounds(block(True), block(False), pivots)
    scores = x @ x.T
    assert (least <= scores).all() and (scores <= largest).all()
    assert (largest - least < 2 * np.abs(scores).max()).any()


def test_pivots_of_equal_rows_and_wrapped_sums():
    assert len(negatives.choose_pivots([(b"\1\0\0\0", 1)] * 5, 1, 4).more) == 1
    big = np.array([[2**31 - 1, -(2**31), 2**31 - 1]], np.int64) // 2
    assert negatives.exact_scores(big, big, np.array([0]), np.array([0]))[0] == sum(int(v) ** 2 for v in big[0])


# Byte-level BPE


@pytest.fixture(scope="module")
def plain():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coders():
    return byte_bpe.Encoder(RANKS, vocab.PATTERN), byte_bpe.Decoder(RANKS)


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    pool = "ab \n\t\r'sT1２٣éßñ漢字ก\x00\x1c\x1d\x1e\x1f\x85​ 　😀👩‍👧ʼ’𞤀▁Ġ<|endoftext|>" + "".join(
        chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(300)
    )
    for _ in range(n):
        yield "".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice("  aeiou'stnr\n") for _ in range(rng.randint(0, 40)))
    for c in " \n\ta=-0é漢 ":
        yield from (a + c * k + b for k in (1, 2, 3, 7, 64, 333) for a, b in (("", ""), ("x", "x"), (" ", "")))


def test_ids_of_odd_texts_equal_the_library(plain, coders):
    encoder, decoder = coders
    for text in odd_texts(4000):
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode_ordinary(text), repr(text)
        assert decoder.decode(ids) == text.encode()


def test_offsets_name_every_character_that_a_token_has_a_byte_of(plain, coders):
    encoder, _ = coders
    for text in odd_texts(300, 2):
        at, ids, want = 0, encoder.encode(text), []
        owner = [i for i, c in enumerate(text) for _ in c.encode()]
        for i in np.frombuffer(ids, "<u4").tolist():
            n = len(plain.decode_single_token_bytes(i))
            want.append([owner[at], owner[at + n - 1] + 1])
            at += n
        assert encoder.offsets(ids, text).tolist() == want


def test_split_characters_come_out_whole(plain, coders):
    _, decoder = coders
    text = "a漢😀é𞤀z"
    ids = np.array([plain.encode_single_token(bytes([b])) for b in text.encode()], "<u4")
    for step in (1, 2, 3, 5):
        parts = list(decoder.decode_pieces(ids[k : k + step].tobytes() for k in range(0, len(ids), step)))
        assert "".join(parts) == text and "�" not in "".join(parts)
    assert list(decoder.decode_pieces([ids[:2].tobytes()])) == ["a", "�"]
    assert "".join(decoder.decode_pieces([])) == ""


def test_encoding_and_decoding_tables(spark, plain):
    rows = [(1, "Hello wörld"), (1, ""), (None, None), (2, "x" * 200_000 + " " + "é" * 50_000), (3, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(0)).withColumn("offsets", F.lit(0))
    encoded = byte_bpe.encode_texts(df, RANKS, vocab.PATTERN)
    got = byte_bpe.decode_ids(encoded.withColumn("DECODED", F.lit(1)), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded).decode()) for r in got) == sorted((i or 0, len(plain.encode_ordinary(t or "")), t or "") for i, t in rows)
    assert byte_bpe.encode_texts(df.limit(0), RANKS, vocab.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, b"")], "k int, ids binary")
    assert {r.k: r.decoded for r in byte_bpe.decode_ids(nulls, RANKS).collect()} == {1: None, 2: b""}


def test_op12_over_a_whole_table(spark, plain):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, SF).collect()}
    got = {r.doc_id: r for r in queries.op12_byte_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = plain.encode_ordinary(text)
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# Fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", text, None, None
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return len(units), "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def test_elias_fano_lists():
    rng = random.Random(4)
    for n, universe in [(0, 0), (1, 1), (1, 10**9), (5, 5), (300, 300), (257, 10**6), (5000, 20_000), (1024, 1 << 40)]:
        values = sorted(rng.sample(range(1, universe + 1), n)) if universe < 10**7 else sorted(rng.randrange(universe) for _ in range(n))
        made = fill_middle.EliasFano(np.array(values, np.int64), universe)
        assert [made.select(i) for i in range(n)] == values
        with pytest.raises(IndexError):
            made.select(n)
    words = np.cumsum(np.full(100_000, 6))
    assert fill_middle.EliasFano(words, int(words[-1])).nbytes() < 100_000 * 5 / 8 + 5_000


def test_token_ends_of_odd_texts():
    for text in [*odd_texts(500, 3), "", " ", "a", " a", "a ", "\n a\t\tb \n", "\x1c\x1d a"]:
        assert fill_middle.token_ends(text).tolist() == np.cumsum([len(u) for u in UNIT.findall(text)]).astype(int).tolist()


def test_fill_in_middle_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [*odd_texts(60, 5), None, "", "has <P> mark", "<", "<S", "S> a <P", "a < S> b", "é " * 20_000, "word " * 100_000, "\t \n"]
    rows = [(i, rng.choice(texts)) for i in range(500)] + [(None, "a b c"), (7, "a b c d"), (7, "a b c d")] + [(1000 + i, "copy of one text " * 5) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(0)).withColumn("share", F.lit(0)).withColumn("output", F.lit("x")).repartition(5)
    made = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in made), key=key) == sorted(((i, *brute_fim(i, t)) for i, t in rows), key=key)
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_copies_are_dealt_and_share_one_entry(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one hot text").otherwise(F.col("id").cast("string")).alias("text"))
    dealt = fill_middle.dealt_texts(df, "doc_id", "text")
    hot = dealt.where("text = 'one hot text'").groupBy("key", "share").count().collect()
    assert len({r.key for r in hot}) == 1 and max(r["count"] for r in hot) <= 2 * 5000 / 500


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fill_middle.F, "md5", lambda c: F.lit("same"))
    rows = [(i, f"text {i % 7} of seven") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) for r in fill_middle.fill_in_middle(df).collect()}
    assert made == {i: brute_fim(i, t) for i, t in rows}
