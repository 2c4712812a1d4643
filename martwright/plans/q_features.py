"""Catalogue: dummies, indexing, winsorising, z-scores, correlation, chi-square."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import discover_values
from ..operators import encode as EN
from ..operators import features as FT
from .catalog import query, tables
from .q_marts import _sql_dummies

_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("dummies", f"""
SELECT c_custkey, {", ".join(_sql_dummies("NULLIF(c_mktsegment, 'HOUSEHOLD')", _SEGS, "seg", False))}
FROM customer""")
def dummies(spark, sf):
    (c,) = tables(spark, sf, "customer")
    x = c.select("c_custkey", F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("seg"))
    return EN.dummies(x, "seg", values=_SEGS, prefix="seg")


@query("dummies_drop_first", f"""
SELECT c_custkey, {", ".join(_sql_dummies("c_mktsegment", _SEGS, "seg", True))} FROM customer""")
def dummies_drop_first(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return EN.dummies(c.select("c_custkey", "c_mktsegment"), "c_mktsegment",
                      values=discover_values(c, "c_mktsegment"),
                      prefix="seg", drop_first=True)


@query("string_index", """
WITH f AS (SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1),
r AS (SELECT o_orderpriority, CAST(ROW_NUMBER() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS DOUBLE) AS o_orderpriority_index FROM f)
SELECT o.o_orderkey, o.o_orderpriority, r.o_orderpriority_index FROM orders o LEFT JOIN r USING (o_orderpriority)""")
def string_index(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return EN.string_index(o.select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query("winsorize", """
WITH r AS (SELECT o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice) AS rn, COUNT(*) OVER () AS n FROM orders),
cap AS (SELECT MAX(o_totalprice) AS c FROM r WHERE rn = n - CAST(floor(0.01 * n) AS BIGINT))
SELECT o_orderkey, o_totalprice, LEAST(o_totalprice, (SELECT c FROM cap)) AS o_totalprice_w FROM orders""")
def winsorize(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return EN.winsorize(o.select("o_orderkey", "o_totalprice"), ["o_totalprice"], upper=0.01)


_ZC = ["o_totalprice"]


@query("zscore", """
SELECT o_orderkey, round((o_totalprice - (SELECT AVG(o_totalprice) FROM orders))
                          / (SELECT STDDEV_POP(o_totalprice) FROM orders), 6) AS o_totalprice_z FROM orders""")
def zscore(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_orderkey", "o_totalprice")
    z = EN.zscore_transform(x, EN.zscore_fit(x, _ZC), _ZC)
    return z.select("o_orderkey", F.round("o_totalprice_z", 6).alias("o_totalprice_z"))


@query("zscore_inverse", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice_orig FROM orders")
def zscore_inverse(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_orderkey", "o_totalprice")
    st = EN.zscore_fit(x, _ZC).first().asDict()
    z = EN.zscore_transform(x, st, _ZC)
    back = EN.zscore_inverse(z, st, _ZC)
    return back.select("o_orderkey", F.round("o_totalprice_orig", 4).alias("o_totalprice_orig"))


@query("vector_l1_normalize", """
SELECT vec_id, list_transform(embedding, lambda v: round(CAST(v AS DOUBLE) / norm, 6)) AS l1
FROM (SELECT *, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS norm FROM embeddings)""")
def vector_l1_normalize(spark, sf):
    (e,) = tables(spark, sf, "embeddings")
    return e.select("vec_id", F.transform(EN.l1_normalize("embedding"), lambda v: F.round(v, 6)).alias("l1"))


_LF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(label_expr: str, where: str = "") -> str:
    parts = [f"SELECT '{c}' AS feature, round(corr({c}, {label_expr}), 6) AS corr FROM lineitem" for c in _LF]
    sql = " UNION ALL ".join(parts)
    return f"SELECT * FROM ({sql}) {where}"


def _labelled(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return li.select(*_LF, (F.col("l_returnflag") == "R").cast("int").alias("label"),
                     (F.col("l_discount") >= 0.05).cast("int").alias("label2"))


@query("corr_with_label", _corr_sql("CAST(l_returnflag = 'R' AS INTEGER)"))
def corr_with_label(spark, sf):
    c = FT.corr_with_label(_labelled(spark, sf), _LF, "label")
    return c.select("feature", F.round("corr", 6).alias("corr"))


@query("corr_filter", _corr_sql("CAST(l_discount >= 0.05 AS INTEGER)", "WHERE abs(corr) > 0.12"))
def corr_filter(spark, sf):
    c = FT.corr_with_label(_labelled(spark, sf), _LF, "label2")
    return FT.corr_filter(c.select("feature", F.round("corr", 6).alias("corr")), 0.12)


@query("corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in _LF for b in _LF))
def corr_matrix(spark, sf):
    m = FT.corr_matrix(_labelled(spark, sf), _LF)
    return m.select("a", "b", F.round("corr", 6).alias("corr"))


@query("chi2_statistic", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(SUM(POWER(COALESCE(o, 0) - e, 2) / e), 6) AS chi2,
       CAST((COUNT(DISTINCT v) - 1) * (COUNT(DISTINCT y) - 1) AS BIGINT) AS dof
FROM (SELECT r.v, cc.y, ob.o, CAST(r.rv AS DOUBLE) * cc.cy / t.n AS e
      FROM (SELECT CAST({c} AS VARCHAR) AS v, COUNT(*) AS rv FROM orders GROUP BY 1) r
      CROSS JOIN (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, COUNT(*) AS cy FROM orders GROUP BY 1) cc
      CROSS JOIN (SELECT COUNT(*) AS n FROM orders) t
      LEFT JOIN (SELECT CAST({c} AS VARCHAR) AS v, CAST(o_orderstatus = 'F' AS INTEGER) AS y, COUNT(*) AS o
                 FROM orders GROUP BY 1, 2) ob ON ob.v = r.v AND ob.y = cc.y)""" for c in ["o_orderpriority", "o_custkey"]))
def chi2_statistic(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_orderpriority", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return FT.chi2_statistic(x, ["o_orderpriority", "o_custkey"], "y") \
        .select("feature", F.round("chi2", 6).alias("chi2"), "dof")
