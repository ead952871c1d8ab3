import math
import random

import pytest

from orelens.llm import vector_topk as V


def brute(rows, k, every):
    good = [(i, [max(-(2**53), min(2**53, math.floor(1024 * x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def vectors(n, dims, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    return rows + [(10**6, None), (10**6 + 10, [float("nan")] * dims), (10**6 + 20, [None] * dims), (10**6 + 30, [float("inf")] * dims), (None, [0.1] * dims), (7, [0.5] * dims), (7, [0.5] * dims), (-10, [0.1] * dims), (10, [9.0] * dims)]


SCHEMA = "vec_id long, embedding array<double>, score string"


def found(spark, rows, k=10, every=10):
    out = V.top_k(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), k, f"vec_id % {every} = 0")
    return sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("dims", [1, 8, 40])
def test_equals_brute_force(spark, dims):
    rows = vectors(400, dims, dims)
    assert found(spark, rows) == brute(rows, 10, 10)


def test_several_blocks_and_small_scans(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERY_BLOCK", 9)
    monkeypatch.setattr(V, "SCAN_ROWS", 16)
    monkeypatch.setattr(V, "HELD", 40)
    rows = vectors(250, 6, 5)
    assert found(spark, rows, 5) == brute(rows, 5, 10)


def test_few_candidates_one_vector_and_none(spark):
    assert found(spark, [(0, [1.0, 2.0]), (1, [1.0]), (2, [-3.0, 0.5])]) == [(0, 1, 1, 1024 * 1024), (0, 2, 2, 1024 * -3072 + 2048 * 512)]
    assert found(spark, [(0, [1.0])]) == []
    assert V.top_k(spark.createDataFrame([], SCHEMA), 10, "vec_id % 100 = 0").count() == 0


def test_large_components(spark):
    rows = [(i, [float(10.0**e), 1.0]) for i, e in ((0, 5), (1, 6), (2, 9), (3, 14), (10, 3))]
    assert found(spark, rows) == brute(rows, 10, 10)


def test_equal_and_near_equal_vectors(spark):
    """Thousands of equal vectors, some under one id, and thousands that share all cells."""
    rng = random.Random(9)
    rows = [(i, [0.25, -0.5, 0.125]) for i in range(3000)] + [(20, [0.25, -0.5, 0.125])] * 40 + [(21, [0.25, -0.5, 0.125])] * 40
    rows += [(5000 + i, [0.25 + rng.randrange(3) / 1024, -0.5, 0.125 + rng.randrange(3) / 1024]) for i in range(3000)] + [(9000, [40.0, 40.0, 40.0]), (9010, [-40.0, -40.0, -40.0])]
    assert found(spark, rows, 10, 500) == brute(rows, 10, 500)
    assert found(spark, rows[:3080], 10, 10) == brute(rows[:3080], 10, 10)
