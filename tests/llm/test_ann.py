import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import ann, queries


def brute(rows, k=10, every=100):
    rows = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and None not in v
                   and all(map(math.isfinite, v)) and any(v)})
    m = np.array([v for _, v in rows])
    ids = np.array([i for i, _ in rows])
    out = {}
    for q, v in zip(ids, m, strict=True):
        if q % every == 0:
            d = np.sqrt(np.cumsum((m - v) ** 2, axis=1)[:, -1])
            out[int(q)] = sorted((float(x), int(i)) for x, i in zip(d, ids, strict=True) if i != q)[:k]
    return out


def said(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
    return hits / sum(map(len, want.values()))


def table(spark, path):
    return spark.read.parquet(f"{path}/embeddings.parquet")


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, path).collect()]
    got, want = said(queries.op8(spark, path)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.99
    assert all(len(got[q]) == 10 and got[q][0] == w[0] for q, w in want.items())


def test_many_blocks(spark, monkeypatch):
    """The blocks of the top tree, their order and the second round, on a table of many small blocks."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 150)
    path = "/root/testdata/sf0.1"
    df = table(spark, path)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    got, want = said(ann.nearest(df, F.col("_id") % 100 == 0)), brute(rows)
    assert set(got) == set(want) and recall(got, want) >= 0.97


def test_repeated_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(1, 120)]
    rows += [(i, [1.0] * 6) for i in range(200, 260)] + [(200, [1.0] * 6), (300, [1.0] * 6), (300, [2.0] * 6)]
    rows += [(400, None), (500, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (700, [None] + [1.0] * 5), (800, [1.0]),
             (900, [float("inf")] * 6), (None, [1.0] * 6), (1000, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_id", F.lit("clash")).withColumn("_v", F.lit(0))
    same = [r for r in rows if r[1] is not None and len(r[1]) == 6]
    found = ann.nearest(df, F.col("_id") % 100 == 0)
    got, want = said(found.filter("query_id != 300")), brute(same)
    assert set(got) == {100, 200} and got[100] == want[100] and got[200] == want[200] and got[200][0] == (0.0, 201)
    # id 300 has two vectors: each is a query of its own, and neither lists the other
    twice = found.filter("query_id = 300").collect()
    assert sorted(r["rank"] for r in twice) == sorted([*range(1, 11)] * 2) and all(r.vec_id != 300 for r in twice)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0]), (5, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert said(ann.nearest(df, F.col("_id") % 100 == 0)) == {0: [(0.0, 5), (math.sqrt(2), 100)], 100: [(math.sqrt(2), 0), (math.sqrt(2), 5)]}
    assert ann.nearest(df.limit(0), F.col("_id") % 100 == 0).count() == 0
    assert ann.nearest(df, F.col("_id") == -1).count() == 0


@pytest.mark.parametrize(("p", "dims", "x"), [(0.95, 2, 5.9915), (0.99, 8, 20.0902), (0.5, 4, 3.3567)])
def test_chi_square(p, dims, x):
    assert abs(ann.chi_square_quantile(p, dims) - x) < 1e-3


def test_blocks_in_parts_and_few_queries_at_a_time(spark, monkeypatch):
    """Two cells only, so that blocks are dealt out in parts, and two queries a slice: the same neighbours."""
    df = table(spark, "/root/testdata/sf0.01")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in df.collect()]
    every = F.col("_id") % 20 == 0
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ann, "QUERIES", 2)
    got, want = said(ann.nearest(df, every, confidence=0.99999)), brute(rows, every=20)
    assert set(got) == set(want) and recall(got, want) >= 0.99


@pytest.mark.parametrize("dims", [0, 1, 7])
def test_odd_dimensions_are_refused(spark, dims):
    with pytest.raises(ValueError):
        ann.nearest(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>"), F.col("_id") == 0, dims=dims)
