import math

import pytest
from pyspark.sql import functions as F

from martwright.llm import mixing, queries
from martwright.llm.mixing import cumulative, mix_sources, poisson_count


def test_matches_oracle(spark, small, con):
    got = queries.op10(spark, small).select("doc_id", "source", "copy").collect()
    assert sorted(map(tuple, got)) == sorted((a, b, c) for a, b, c in con.execute(
        "SELECT doc_id, source, copy FROM (" + queries.ORACLE["op10_mix_sources"] + ")").fetchall())


def invert(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while u >= c:
        k += 1
        p *= rate / k
        c += p
    return k


def test_inversion(spark):
    cases = [(r, u) for r in (0.01, 0.5, 1.0, 3.7, 15.9, 130.0, 512.0) for u in (0.0, 0.1, 0.5, 0.9, 0.999999, 1 - 2 ** -40)]
    df = spark.createDataFrame(cases, "r double, u double")
    for x in df.select("r", "u", poisson_count(cumulative(F.col("r")), F.lit(1).cast("long"), F.col("u")).alias("k")).collect():
        assert x.k == invert(x.r, x.u), x


def test_large_rate_has_the_right_mean(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "'s' as source")
    n = mix_sources(df, {"s": 1.0}, total=400_000).count()
    assert abs(n - 400_000) < 5 * math.sqrt(400_000)


def test_copies_of_one_document_are_made_in_many_tasks(spark):
    """A source of one document among ten: its copies come in blocks, numbered throughout."""
    df = spark.range(20_001).selectExpr("id as doc_id", "if(id = 0, 'one', concat('s', id % 9)) as source")
    real = mixing.COPIES
    try:
        mixing.COPIES = 64
        out = mix_sources(df)
        plan = out._jdf.queryExecution().toString()
        got = sorted(r._copy for r in out.filter("doc_id = 0").collect())
    finally:
        mixing.COPIES = real
    assert abs(len(got) - 2000) < 5 * math.sqrt(2000) and got == list(range(1, len(got) + 1))
    assert plan.count("Generate explode") >= 2 and "REPARTITION" in plan
    assert sorted(r._copy for r in mix_sources(df).filter("doc_id = 0").collect()) == got


def test_shares_follow_the_weights_under_skew(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' when id % 100 = 1 then null"
                                        " else concat('s', id % 4) end as source", "concat('t', id) as text")
    weights = {"hot": 1.0, "s0": 2.0, "s1": 1.0, None: 1.0}
    got = {r.source: r.n for r in mix_sources(df, weights).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == set(weights)                      # s2, s3 have no weight
    for s, w in weights.items():
        assert abs(got[s] - w / 5 * 30_000) < 6 * math.sqrt(30_000)


def test_same_under_other_partitioning(documents):
    rows = lambda df: sorted((r.doc_id, r._copy, r.text) for r in mix_sources(df).collect())
    assert rows(documents) == rows(documents.repartition(7, "doc_id"))


def test_order_mixes_sources(documents):
    got = mix_sources(documents.repartition(1).sortWithinPartitions("source")).collect()
    runs = sum(a.source != b.source for a, b in zip(got, got[1:], strict=False))
    assert runs > len(got) / 2


def test_odd_rows(odd, empty):
    out = mix_sources(odd, numbered=False)
    assert out.columns == odd.columns
    want = {(r.doc_id, r.text) for r in odd.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} <= want
    assert mix_sources(empty).count() == 0
    assert mix_sources(odd, {"nowhere": 1.0}).count() == 0


@pytest.mark.parametrize("weights", [{}, {"src0": 0.0}])
def test_no_weights(documents, weights):
    assert mix_sources(documents, weights).count() == 0


@pytest.mark.parametrize("weight", [float("nan"), float("inf"), -1.0, None])
def test_weights_that_are_none(documents, weight):
    with pytest.raises(ValueError):
        mix_sources(documents, {"src0": weight})
