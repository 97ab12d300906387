"""The query of packed members: odd rows, and how much memory its members ask for."""

import hashlib
import lzma
import os

from stateloom import queries
from stateloom.sources import members


def test_packed_members_ask_for_memory_by_their_length():
    for n in (0, 1, 5000, 300_000):
        text = "".join(f"{i * i} é\n" for i in range(n // 8))
        packed = members.packed(text.encode(), ".xz")
        # The usual dictionary of 8 MB does not fit this limit, whatever the text.
        assert lzma.LZMADecompressor(memlimit=2 << 20).decompress(packed).decode() == text


def test_one_worker_packs_and_reads(spark):
    """Two steps of Python in a row would be two workers a core, with a batch of packed members between them."""
    made = queries.queries()["member_lines"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_odd_rows(spark, tmp_path):
    texts = [(None, "a\nb"), (None, None), (1, None), (2, ""), (3, "\n\nx\n"), (5, "é\r\n" * 3), (7, "y" * 100_000 + "\nz")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(os.path.join(tmp_path, "documents.parquet"))
    got = sorted(((r.doc_id or 0), r.line_no, r.offset, r.line_sha256) for r in queries.queries()["member_lines"](spark, str(tmp_path)).collect())
    want = []
    for key, text in texts:
        at, lines = 0, (text or "").split("\n")
        for i, line in enumerate(lines[:-1] if lines[-1] == "" else lines):
            want.append((key or 0, i, at, hashlib.sha256(line.encode()).hexdigest()))
            at += len(line.encode()) + 1
    assert got == sorted(want)
