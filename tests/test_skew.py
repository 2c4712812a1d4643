"""Hot keys: a third of all rows on one key must give the same results.

The hot-key inputs are derived from the driver tables in the test (never in
a registered query) and the expected values come from DuckDB on the same
derivation.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from martwright.operators import aggregate as G
from martwright.operators.columns import decimals_to_double, money
from martwright.operators.evaluate import auc
from martwright.operators.sampling import split_stratified
from martwright.plans import donor as D

SF = "/root/testdata/sf0.01"
HOT_SQL = ("CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _hot_orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    return o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(1).cast("bigint"))
                        .otherwise(F.col("o_custkey")))


def test_trailing_windows_with_hot_customer(spark, con):
    gifts = D.gifts_from_orders(_hot_orders(spark))
    wins = {"w1": "1999-01-01", "w_all": "1995-01-17"}
    got = {r.donor_id: (r.w1, r.w_all) for r in decimals_to_double(
        G.trailing_window_sums(gifts, "donor_id", "date", "amount", "2000-01-01", wins)).collect()}
    exp = {r[0]: (r[1], r[2]) for r in con.execute(f"""
        SELECT {HOT_SQL} AS k,
          CAST(SUM(CASE WHEN o_orderdate > DATE '1999-01-01' THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3)) END) AS DOUBLE),
          CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2)) * CAST('0.001' AS DECIMAL(4,3))) AS DOUBLE)
        FROM orders WHERE o_orderdate > DATE '1995-01-17' AND o_orderdate < DATE '2000-01-01'
        GROUP BY 1""").fetchall()}
    assert got == exp
    assert got[1][1] > 10 * sorted(v[1] for v in got.values())[-2]   # key 1 is really hot


def test_pivot_with_hot_customer(spark, con):
    o = _hot_orders(spark).select("o_custkey", "o_orderstatus", money("o_totalprice").alias("a"))
    got = {r.o_custkey: (r.total_F, r.n_F) for r in decimals_to_double(G.pivot_agg(
        o, "o_custkey", "o_orderstatus", [("sum", "a", "total"), ("count", "a", "n")],
        values=["F", "O", "P"])).collect()}
    exp = {r[0]: (r[1], r[2]) for r in con.execute(f"""
        SELECT {HOT_SQL},
          CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE),
          COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END)
        FROM orders GROUP BY 1""").fetchall()}
    assert got == exp


def test_fanout_join_with_hot_order(spark, con):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").withColumn(
        "l_orderkey", F.when(F.col("l_linenumber") <= 2, F.lit(1).cast("bigint")).otherwise(F.col("l_orderkey")))
    o = spark.read.parquet(f"{SF}/orders.parquet")
    j = o.join(li, o.o_orderkey == li.l_orderkey, "left").groupBy("o_custkey").agg(F.count("l_linenumber").alias("n"))
    got = dict(j.collect())
    exp = dict(con.execute("""
        SELECT o_custkey, COUNT(l_linenumber) FROM orders o LEFT JOIN
          (SELECT CASE WHEN l_linenumber <= 2 THEN 1 ELSE l_orderkey END AS k, l_linenumber FROM lineitem) l
          ON o.o_orderkey = l.k GROUP BY 1""").fetchall())
    assert got == exp


def test_rank_based_ops_with_dominant_class(spark, con):
    o = _hot_orders(spark).select("o_orderkey", F.when(F.col("o_custkey") == 1, "hot").otherwise("rest").alias("c"))
    s = split_stratified(o, "c", ["o_orderkey"], 0.7).groupBy("c", "split").count().collect()
    got = {(r.c, r.split): r["count"] for r in s}
    n_hot = o.where("c = 'hot'").count()
    assert got[("hot", "train")] == (n_hot * 7 + 5) // 10
    # AUC with one score value holding a third of the rows
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(0.5)).otherwise(F.col("l_discount")).alias("s"))
    a = auc(li, "y", "s").first()[0]
    e = con.execute("""
        WITH t AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y,
                          CASE WHEN l_linenumber % 3 = 0 THEN 0.5 ELSE l_discount END AS s FROM lineitem),
        c AS (SELECT s, COUNT(*) FILTER (WHERE y = 1) AS pos, COUNT(*) FILTER (WHERE y = 0) AS neg FROM t GROUP BY s),
        d AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
        SELECT SUM(pos * (below + neg / 2.0)) / (SUM(pos) * SUM(neg)) FROM d""").fetchone()[0]
    assert a == pytest.approx(e, abs=1e-12)
