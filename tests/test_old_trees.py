"""Manifests, settings and identities of old tasks."""

import bz2
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stateloom.plans import old_trees


def plain_digest(body):
    lines = body.splitlines(keepends=True) if b"\r" not in body else [x + b"\n" for x in body.split(b"\n")]
    return hashlib.sha256(body if len(lines) < 3 else b"".join(lines[:-2])).hexdigest()


def test_manifest_digests_cover_all_but_the_last_two_lines():
    rng = random.Random(2)
    bodies = [b"", b"a", b"a\n", b"a\nb", b"a\nb\n", b"a\nb\nc", b"a\nb\nc\n", b"\n\n\n", b"\n\n\nx"]
    bodies += [b"\n".join(b"y" * rng.randrange(90) for _ in range(rng.randrange(1, 5000))) + rng.choice([b"", b"\n"]) for _ in range(10)]
    for body in bodies:
        assert old_trees.manifest_digest(bz2.compress(body)) == plain_digest(body), body[:20]
    assert old_trees.manifest_digest(bz2.compress(b"abc\n" * 99)[:-7]) is None


@pytest.mark.parametrize(
    ("config", "want"),
    [("[main]\ndescription = a b \n", "a b"), ("[x]\ndescription=no\n", None), ("[main]\nDESCRIPTION: c\n[x]\n", "c"), ("", None), (None, None), ("[main]\n[x]\ndescription=no", None), ("[main]\nadescription=no", None)],
)
def test_descriptions(spark, config, want):
    assert spark.createDataFrame([(config,)], "c string").select(old_trees.description_of(F.col("c"))).first()[0] == want
