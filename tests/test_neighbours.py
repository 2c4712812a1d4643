"""Exact k nearest neighbours against all pairs, and how much the pruning leaves out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from martwright.operators.neighbours import k_nearest, knn_classify

SCHEMA = "id long, v array<float>, label int"


def brute(rows, queries, k):
    """id -> [(distance, id, label)]; distances of the stored (single) values."""
    out = {}
    for q, v, _ in rows:
        if q in queries:
            near = sorted((math.dist(v, w), i, y) for i, w, y in rows if i != q and y is not None)
            out[q] = near[:k]
    return out


def clustered(n, dims, seed, spread=0.05, kinds=12):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-4, 4) for _ in range(dims)] for _ in range(kinds)]
    single = lambda x: float(__import__("struct").unpack("f", __import__("struct").pack("f", x))[0])
    return [(i, [single(c + rnd.gauss(0, spread)) for c in centres[i % kinds]], i % kinds) for i in range(n)]


def told(df):
    return {r._id: [(round(x.distance, 9), x.id, x.label) for x in r._near] for r in df.collect()}


def plain(want):
    return {q: [(round(d, 9), i, y) for d, i, y in near] for q, near in want.items()}


@pytest.mark.parametrize(("spread", "block_rows"), [(0.05, 50), (3.0, 50), (0.05, 4_096)])
def test_equals_all_pairs(spark, spread, block_rows):
    rows = clustered(900, 6, 1, spread)
    queries = {i for i in range(900) if i % 30 == 0}
    got, report = k_nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 30 == 0, 7, "id", "v", "label", block_rows=block_rows)
    assert told(got) == plain(brute(rows, queries, 7))
    assert sum(r["visits"] for r in report) <= len(queries) * report[0]["blocks"]
    if spread < 1 and block_rows == 50:         # clusters apart: most blocks are ruled out
        assert report[0]["blocks"] == 18 and sum(r["visits"] for r in report) < 0.35 * len(queries) * 18


def test_hot_vector_and_few_queries_at_a_time(spark, monkeypatch):
    """A third of all rows are one vector: many blocks, every tie to the smaller id; visits come in parts."""
    from martwright.operators import neighbours
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    rows = [(i, [1.0, 2.0, 3.0], 0) if i % 3 == 0 else (i, [float(i % 7), float(i % 5), 0.5], i % 2) for i in range(600)]
    queries = {i for i in range(600) if i % 20 == 0}
    got, report = k_nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 20 == 0, 5, "id", "v", "label", block_rows=40)
    assert told(got) == plain(brute(rows, queries, 5)) and report[0]["blocks"] == 15


def test_odd_rows(spark):
    rows = [(0, [0.0, 0.0], 1), (1, [0.0, 0.0], None), (2, [3.0, 4.0], 2), (None, [0.0, 0.0], 1), (3, None, 1), (4, [1.0], 1),
            (5, [float("nan"), 0.0], 1), (6, [None, 1.0], 1), (7, [], 1), (8, [0.0, 1.0], 2), (9, [float("inf"), 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_v", F.lit("clash")).withColumn("_near", F.lit(1))
    got, _ = knn_classify(df, F.col("id") >= 0, 3, "id", "v", "label")
    assert {r.id: (r.predicted, r.votes) for r in got.collect()} == {0: (2, 2), 1: (2, 2), 2: (1, 1), 8: (1, 1)}
    none, report = knn_classify(df.limit(0), F.col("id") >= 0, 3, "id", "v", "label")
    assert none.count() == 0 and report == []
    alone, _ = knn_classify(df.where("id = 0"), F.col("id") >= 0, 3, "id", "v", "label")
    assert [tuple(r) for r in alone.collect()] == [(0, None, 0)]
    unlabelled, _ = knn_classify(df.where("id = 1"), F.col("id") >= 0, 3, "id", "v", "label")
    assert [tuple(r) for r in unlabelled.collect()] == [(1, None, 0)]


def test_no_row_pairs_in_the_plan(spark):
    rows = clustered(300, 4, 2)
    got, _ = k_nearest(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, 3, "id", "v", "label", block_rows=30)
    plan = got._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
