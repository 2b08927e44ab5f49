"""Exact top-k against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelens.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, score string"


def brute(rows, k=5, mod=50):
    good = []
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [int(np.floor(256 * x)) for x in v]))
    out = set()
    for i, v in good:
        if i % mod:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in good if j != i and len(w) == len(v))
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def run(spark, rows):
    out = topk.op2(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in out}
    assert len(got) == len(out)
    return got


def test_matches_brute_force_with_ties_and_bad_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, -0.4, 0.0, 0.25, 0.7]) for _ in range(4)], 0, "x") for i in range(320)]
    rows += [(400, None, 0, None), (450, [1.0, None, 0.0, 0.0], 0, None), (500, [float("nan"), 0.0, 0.0, 0.0], 0, ""),
             (550, [float("inf"), 1.0, 1.0, 1.0], 0, ""), (600, [0.5, 0.5], 0, ""), (601, [0.5, -0.5], 0, ""),
             (None, [0.1, 0.1, 0.1, 0.1], 0, "")]
    assert run(spark, rows) == brute(rows)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 2.0], 0, ""), (7, [0.3, 0.1], 0, ""), (8, [0.3, 0.1], 0, "")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()


def test_many_blocks_agree_with_one(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 16)]) for i in range(600)]
    vectors = topk.scaled_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    queries = vectors.where(F.col("id") % 10 == 0)
    cols = ["query_id", "rank", "vec_id", "score"]
    many = {tuple(r) for r in topk.nra_topk(queries, vectors, 5, 64).select(cols).collect()}
    assert many == {tuple(r) for r in topk.nra_topk(queries, vectors, 5, 4096).select(cols).collect()}
    assert many == brute([(i, v) for i, v in rows], 5, 10)


def test_stops_early_on_a_clear_winner():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 3, (4000, 16))).astype(np.int64)
    x[17] = 200
    x[18:22] = 190
    found = topk.block_topk(np.array([-1]), np.full((1, 16), 50), np.arange(4000), x, 5)
    ids = np.concatenate([f[1] for f in found])
    assert ids.tolist() == [17, 18, 19, 20, 21] and found[0][3].max() < 1


def test_large_numbers_stay_exact_or_raise():
    x = np.array([[2 ** 27 + 1, 3], [2 ** 27, 5], [7, 7]], dtype=np.int64)
    found = topk.block_topk(np.array([9]), np.array([[2 ** 27 + 3, 1]]), np.arange(3), x, 2)
    score = np.concatenate([f[2] for f in found]).tolist()
    assert score == [(2 ** 27 + 1) * (2 ** 27 + 3) + 3, 2 ** 27 * (2 ** 27 + 3) + 5]
    with pytest.raises(OverflowError):
        topk.block_topk(np.array([9]), np.array([[2 ** 40]]), np.arange(1), np.array([[2 ** 40]]), 1)
