"""Catalogue: joins, aggregation, pivots, ordering and union."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as G
from ..operators import joins as J
from ..operators import ordering as O
from ..operators.columns import decimals_to_double, money
from . import bank as B
from .catalog import query, tables

_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _dec(c):
    return f"CAST({c} AS DECIMAL(18,2))"


# ----------------------------------------------------------------------- joins

@query("join_left", """
SELECT c.c_custkey, c.c_mktsegment, a.n_orders
FROM customer c LEFT JOIN (SELECT o_custkey, COUNT(*) AS n_orders FROM orders
                           WHERE o_orderdate < DATE '1996-01-01' GROUP BY o_custkey) a
  ON c.c_custkey = a.o_custkey""")
def join_left(spark, sf):
    c, o = tables(spark, sf, "customer", "orders")
    a = (o.where(F.col("o_orderdate") < F.to_date(F.lit("1996-01-01")))
         .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders")))
    return J.join_left(c.select("c_custkey", "c_mktsegment"), a, "c_custkey")


@query("join_left_composite", """
WITH oy AS (SELECT o_custkey AS cust, CAST(year(o_orderdate) AS INTEGER) AS yr,
                   CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ordered
            FROM orders GROUP BY 1, 2),
     sy AS (SELECT o.o_custkey AS cust, CAST(year(l.l_shipdate) AS INTEGER) AS yr, COUNT(*) AS shipped_lines
            FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
SELECT oy.cust, oy.yr, oy.ordered, sy.shipped_lines
FROM oy LEFT JOIN sy ON oy.cust = sy.cust AND oy.yr = sy.yr""")
def join_left_composite(spark, sf):
    o, li = tables(spark, sf, "orders", "lineitem")
    oy = o.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("yr")) \
        .agg(F.sum(money("o_totalprice")).cast("double").alias("ordered"))
    sy = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")) \
        .groupBy(F.col("o_custkey").alias("cust"), F.year("l_shipdate").alias("yr")) \
        .agg(F.count(F.lit(1)).alias("shipped_lines"))
    return J.join_left(oy, sy, ["cust", "yr"])


@query("join_inner", """
SELECT l.l_orderkey, l.l_linenumber, p.p_brand, p.p_type
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""")
def join_inner(spark, sf):
    li, p = tables(spark, sf, "lineitem", "part")
    return J.join_inner(li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("pk")),
                        p.select(F.col("p_partkey").alias("pk"), "p_brand", "p_type"), "pk") \
        .drop("pk")


@query("join_fanout_totals", f"""
SELECT o.o_custkey, COUNT(o.o_orderkey) AS n_order_rows,
       CAST(SUM({_dec('o.o_totalprice')}) AS DOUBLE) AS fanned_total
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_custkey""")
def join_fanout_totals(spark, sf):
    o, li = tables(spark, sf, "orders", "lineitem")
    j = J.join_left(o.select(F.col("o_orderkey").alias("k"), "o_custkey", money("o_totalprice").alias("p")),
                    li.select(F.col("l_orderkey").alias("k"), "l_linenumber"), "k")
    return j.groupBy("o_custkey").agg(F.count("k").alias("n_order_rows"),
                                      F.sum("p").cast("double").alias("fanned_total"))


# ----------------------------------------------------------------- aggregation

@query("agg_entity", f"""
SELECT o_custkey, COUNT(o_totalprice) AS count_o_totalprice,
  CAST(SUM({_dec('o_totalprice')}) AS DOUBLE) AS sum_o_totalprice,
  CAST(SUM({_dec('o_totalprice')}) AS DOUBLE) / COUNT(o_totalprice) AS mean_o_totalprice,
  CAST(MIN(o_totalprice) AS DOUBLE) AS min_o_totalprice, CAST(MAX(o_totalprice) AS DOUBLE) AS max_o_totalprice,
  MIN(o_orderdate) AS min_o_orderdate, MAX(o_orderdate) AS max_o_orderdate
FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey""")
def agg_entity(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_custkey", money("o_totalprice").alias("o_totalprice"), "o_orderdate")
    return decimals_to_double(G.entity_aggregates(
        x, "o_custkey", {"o_totalprice": ["count", "sum", "mean", "min", "max"],
                         "o_orderdate": ["min", "max"]}))


def _pivot_count_sql():
    cols = ", ".join(f"COUNT(CASE WHEN o_orderpriority = '{v}' THEN o_orderkey END) AS n_{G.safe_name(v)}"
                     for v in _PRIOS)
    return f"SELECT o_custkey, {cols} FROM orders GROUP BY o_custkey"


@query("pivot_count", _pivot_count_sql())
def pivot_count(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return G.pivot_agg(o, "o_custkey", "o_orderpriority", [("count", "o_orderkey", "n")],
                       values=_PRIOS)


def _pivot_multi_sql():
    parts = []
    for v in ["F", "O", "P"]:
        cond = f"o_orderstatus = '{v}'"
        parts += [f"CAST(SUM(CASE WHEN {cond} THEN {_dec('o_totalprice')} END) AS DOUBLE) AS total_{v}",
                  f"COUNT(CASE WHEN {cond} THEN o_orderkey END) AS n_{v}",
                  f"MAX(CASE WHEN {cond} THEN o_totalprice END) AS max_{v}"]
    return f"SELECT o_custkey, {', '.join(parts)} FROM orders GROUP BY o_custkey"


@query("pivot_multi", _pivot_multi_sql())
def pivot_multi(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_custkey", "o_orderkey", "o_orderstatus", money("o_totalprice").alias("amt"),
                 "o_totalprice")
    p = G.pivot_agg(x, "o_custkey", "o_orderstatus",
                    [("sum", "amt", "total"), ("count", "o_orderkey", "n"), ("max", "o_totalprice", "max")],
                    values=["F", "O", "P"])
    return decimals_to_double(p)


def _pivot_mean_sql():
    ops = B.OPERATIONS
    inner = f"""
SELECT account_id, operation, k_symbol, COUNT(amount) AS n, SUM(amount) AS s,
       CAST(SUM(amount) AS DOUBLE) / COUNT(amount) AS m
FROM ({_trans_sql()}) t GROUP BY 1, 2, 3"""
    cols = []
    for v in ops:
        nm = G.safe_name(v)
        c = f"operation = '{v}'"
        cols += [f"SUM(CASE WHEN {c} THEN n END) / COUNT(CASE WHEN {c} THEN n END) AS op_count_{nm}",
                 f"CAST(SUM(CASE WHEN {c} THEN s END) AS DOUBLE) / COUNT(CASE WHEN {c} THEN s END) AS op_sum_{nm}",
                 f"round(CAST(SUM(CASE WHEN {c} THEN CAST(m AS DECIMAL(28,8)) END) AS DOUBLE)"
                 f" / NULLIF(COUNT(CASE WHEN {c} THEN m END), 0), 6) AS op_mean_{nm}"]
    return f"SELECT account_id, {', '.join(cols)} FROM ({inner}) g GROUP BY account_id"


def _case(col, mapping, default="NULL"):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + \
        f" ELSE {default} END"


def _trans_sql():
    from ..functions.recode import (TRANS_K_SYMBOL, TRANS_K_SYMBOL_DEFAULT, TRANS_OPERATION,
                                    TRANS_OPERATION_DEFAULT, TRANS_TYPE, TRANS_TYPE_DEFAULT)
    return f"""
SELECT o.o_custkey AS account_id, CAST(l.l_shipdate AS DATE) AS date,
  {_case(_case('o.o_orderstatus', B.TYPE_CODE), TRANS_TYPE, repr(TRANS_TYPE_DEFAULT))} AS type,
  {_case(_case('o.o_orderpriority', B.OPERATION_CODE), TRANS_OPERATION, repr(TRANS_OPERATION_DEFAULT))} AS operation,
  {_case(_case('l.l_returnflag', B.K_SYMBOL_CODE), TRANS_K_SYMBOL, repr(TRANS_K_SYMBOL_DEFAULT))} AS k_symbol,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""


def _round_mean_cols(df):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith("op_mean_") else F.col(c)
                       for c in df.columns])


@query("pivot_mean_of_groups", _pivot_mean_sql())
def pivot_mean_of_groups(spark, sf):
    li, o = tables(spark, sf, "lineitem", "orders")
    return _round_mean_cols(B.trans_by_operation(B.transactions(li, o)))


@query("pivot_drop_null", f"""
SELECT l_orderkey, {", ".join(f"COUNT(CASE WHEN c = '{v}' THEN 1 END) AS n_{v}" for v in ["A", "R"])}
FROM (SELECT l_orderkey, NULLIF(l_returnflag, 'N') AS c FROM lineitem) GROUP BY l_orderkey""")
def pivot_drop_null(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    x = li.select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("c"))
    return G.pivot_agg(x, "l_orderkey", "c", [("count_rows", None, "n")], values=G.discover_values(x, "c"),
                       null_category="drop")


_YRS = list(range(1992, 2002))


@query("pivot_calendar", f"""
WITH g AS (SELECT o_custkey AS k, o_orderdate AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS a
           FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate < DATE '2000-01-01'),
p AS (SELECT k, {", ".join(f"SUM(CASE WHEN year(d) = {y} THEN a END) AS y{y}" for y in range(1995, 2000))},
      {", ".join(f"SUM(CASE WHEN month(d) = {m} THEN a END) AS m{m}" for m in range(1, 13))}
      FROM g GROUP BY k)
SELECT k AS o_custkey,
  {", ".join(f"CAST(COALESCE(m{m}, 0) AS DOUBLE) AS month_{m}" for m in range(1, 13))},
  {" + ".join(f"CAST(COALESCE(y{y}, 0) > 0 AS INTEGER)" for y in range(1995, 2000))} AS frequency_gifts,
  CAST(COALESCE(m1,0) + COALESCE(m2,0) + COALESCE(m3,0) AS DOUBLE) AS Q1,
  CAST(COALESCE(m5,0) + COALESCE(m6,0) + COALESCE(m7,0) AS DOUBLE) AS Q2,
  CAST(COALESCE(m7,0) + COALESCE(m8,0) + COALESCE(m9,0) AS DOUBLE) AS Q3,
  CAST(COALESCE(m10,0) + COALESCE(m11,0) + COALESCE(m12,0) AS DOUBLE) AS Q4
FROM p""")
def pivot_calendar(spark, sf):
    """Calendar pivot with the reference's May-July second quarter."""
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_custkey", "o_orderdate", money("o_totalprice").alias("amt"))
    q = {"Q1": (1, 2, 3), "Q2": (5, 6, 7), "Q3": (7, 8, 9), "Q4": (10, 11, 12)}
    return decimals_to_double(G.pivot_calendar(x, "o_custkey", "o_orderdate", "amt",
                                               years=list(range(1995, 2000)), cutoff="2000-01-01",
                                               quarters=q))


@query("churn_label", """
SELECT o_custkey, CAST(MAX(o_orderdate) AS DATE) AS last_end, CAST(MIN(o_orderdate) AS DATE) AS first_start,
  CAST(date_diff('day', CAST(MAX(o_orderdate) AS DATE), DATE '1998-08-31') AS INTEGER) AS days_without,
  CAST(date_diff('day', CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE)) AS INTEGER) AS customer_lifetime,
  CASE WHEN date_diff('day', CAST(MAX(o_orderdate) AS DATE), DATE '1998-08-31') > 180 THEN 1 ELSE 0 END AS label
FROM orders WHERE o_orderdate <= DATE '1998-08-31' GROUP BY o_custkey""")
def churn_label(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.where(F.col("o_orderdate") < F.to_date(F.lit("1998-09-01")))
    return G.churn_label(x, "o_custkey", "o_orderdate", "o_orderdate", "1998-08-31", 180)


# -------------------------------------------------------------------- ordering

@query("top_k", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 10""")
def top_k(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return O.top_k(o.select("o_orderkey", "o_custkey", "o_totalprice"),
                   [("o_totalprice", True), ("o_orderkey", False)], 10)


@query("arg_max", """
SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey_at_max, MAX(o_totalprice) AS max_o_totalprice
FROM orders GROUP BY o_custkey""")
def arg_max(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return O.arg_max(o, "o_orderkey", "o_totalprice", group="o_custkey")


@query("union_all", """
SELECT 'orders' AS src, o_custkey AS cust, o_totalprice AS amount FROM orders
UNION ALL
SELECT 'lineitem' AS src, o.o_custkey AS cust, l.l_extendedprice AS amount
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def union_all(spark, sf):
    o, li = tables(spark, sf, "orders", "lineitem")
    a = o.select(F.lit("orders").alias("src"), F.col("o_custkey").alias("cust"),
                 F.col("o_totalprice").alias("amount"))
    b = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_extendedprice").alias("amount"), F.lit("lineitem").alias("src"),
        F.col("o_custkey").alias("cust"))
    return O.union_all([a, b])
