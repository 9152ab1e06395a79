import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, picked, k, scale=256):
    fit = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for n, (i, v) in enumerate(fit):
        if picked(i):
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(fit) if m != n and len(w) == len(v))[:k]
            found += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(best)]
    return sorted(found)


def run(spark, rows, k=5, kind="double"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("'x' as score", "vec_id", "embedding", "1 as rank", "2 as query_id").repartition(3)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, k).collect())


def test_random_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(400)]
    assert run(spark, rows, kind="float") == brute(rows, lambda i: i % 50 == 0, 5)


def test_ties_copies_nulls_and_lengths(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(0, 2, 3)]) for i in range(300)]
    rows += [(7, [1.0, 1.0, 1.0]), (100, [1.0, 0.0, 1.0]), (None, [1.0, 0.0, 0.0]), (1000, None), (1050, [1.0, math.nan, 0.0]), (1060, [math.inf, 0.0, 0.0])]
    rows += [(1070, [1.0, None, 0.0]), (1100, [1.0, 2.0]), (1150, [2.0, 2.0]), (1200, [5.0]), (1250, [])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    same = [(i, [0.5, -0.25]) for i in range(130)]
    assert run(spark, same, k=3) == brute(same, lambda i: i % 50 == 0, 3)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 3)
    monkeypatch.setattr(topk, "BITS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(150)]
    assert run(spark, rows, k=4) == brute(rows, lambda i: i % 50 == 0, 4)


def test_few_or_no_candidates(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (50, [-1.0])]) == brute([(0, [1.0]), (1, [2.0]), (50, [-1.0])], lambda i: i % 50 == 0, 5)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []


def test_large_numbers(spark):
    rows = [(i, [(-1.0) ** i * 2.0**20 + i, 3.0]) for i in range(101)]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    rows = [(0, [1e12, 1.0]), (1, [2.0, 1.0]), (50, [1.0, 0.5]), (2, [1.0, -1e12])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    with pytest.raises(Exception, match="61 bits"):
        run(spark, [(0, [1e15, 1.0]), (1, [1e15, 1.0])])


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rows = [(50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, 0.0]), (7, [0.0, 1.0])]
    got = run(spark, rows, k=2)
    assert got == brute(rows, lambda i: i % 50 == 0, 2) and [r[2] for r in got].count(50) == 6


def test_a_grid_of_cells(spark, monkeypatch):
    for name, value in (("ROWS", 3), ("SENT", 0), ("GRID", (2, 3))):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = [(10 * i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(120)]
    assert run(spark, rows, k=4) == brute(rows, lambda i: i % 50 == 0, 4)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 160), st.lists(st.floats(-2, 2, width=32), min_size=2, max_size=2)), min_size=1, max_size=40))
def test_any_vectors(spark, rows):
    assert run(spark, rows, k=3) == brute(rows, lambda i: i % 50 == 0, 3)
