import random

import numpy as np
import pytest

import brute
from stateloom.llm import embeddings
from stateloom.llm._scratch import Scratch
from stateloom.llm.components import connected_components


@pytest.mark.parametrize("block", [7, 512])
def test_vectors(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        if i % 4 == 1:
            v = np.array(rows[i - 1][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.1])
        elif i > 250:
            v = np.array(rows[0][1]) + rng.normal(size=16) * 0.05
        else:
            v = rng.normal(size=16)
        rows.append((i, [float(x) for x in v], "clash"))
    nan = float("nan")
    odd = [None, [], [0.0] * 16, [nan] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0] * 8, [2.0] * 8, rows[0][1] + [0.0]]
    df = spark.createDataFrame(rows + [(400 + k, v, "x") for k, v in enumerate(odd)] + [rows[5], (None, rows[0][1], "x")], "vec_id long, embedding array<double>, n_links string")
    got = embeddings.near_duplicate_vectors(df, block=block).collect()
    assert len(got) == df.count()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)))] + [(406, 407)]
    component = brute.components(range(409), links)
    degree = np.bincount(np.array(links).ravel(), minlength=409)
    missed = 0
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
            continue
        assert r.n_links <= degree[r.vec_id] and r.kept == (r.vec_id == r.component_id)
        missed += degree[r.vec_id] - r.n_links
        assert r.component_id == component[r.vec_id]
    assert missed <= 0.02 * degree.sum()
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, j) for j in range(501, 560)]
    df = spark.createDataFrame([*links, (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in connected_components(df, "a", "b", Scratch(spark, "t")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == brute.components({i for x in links for i in x}, links)
    assert connected_components(df.limit(0), "a", "b", Scratch(spark, "t")).count() == 0
