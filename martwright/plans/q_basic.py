"""Catalogue: sources, profiling, projection, filters and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dates import (days_between, decode_birth_number, months_between,
                               parse_compact_ts, parse_yymmdd, relative_date)
from ..functions.recode import (LANGUAGE, PROVINCE_BREAKS, REGION_BREAKS, TRANS_OPERATION,
                                TRANS_OPERATION_DEFAULT, TRANS_TYPE, TRANS_TYPE_DEFAULT, flag,
                                province, recode, recode_passthrough, region)
from ..functions.text import MARKET_URL_PREFIX, MARKET_URL_SUFFIX, clean_zip, market_url
from ..operators import columns as C
from ..operators import filters as FL
from ..operators import profile as P
from ..session import checkpoint_dir
from ..sources.files import read_csv, write_csv
from ..sources.sql import run_sql
from . import donor as D
from .catalog import query, tables
from .q_marts import _sql_ranges

CUSTOMER_SCHEMA = "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
ORDERS_SCHEMA = ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
                 "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING")


def _scratch(spark, what: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------- sources

@query("csv_roundtrip_semicolon", "SELECT * FROM customer")
def csv_semicolon(spark, sf):
    (customer,) = tables(spark, sf, "customer")
    path = _scratch(spark, "csv-semicolon")
    write_csv(customer, path, sep=";")
    return read_csv(spark, path, CUSTOMER_SCHEMA, sep=";")


@query("csv_roundtrip_comma", "SELECT * FROM orders")
def csv_comma(spark, sf):
    (orders,) = tables(spark, sf, "orders")
    path = _scratch(spark, "csv-comma")
    write_csv(orders, path, sep=",")
    return read_csv(spark, path, ORDERS_SCHEMA, sep=",",
                    timestamp_format="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")


@query("sql_over_views", """
SELECT c.c_mktsegment AS segment, COUNT(*) AS n_orders,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY c.c_mktsegment
""")
def sql_over_views(spark, sf):
    orders, customer = tables(spark, sf, "orders", "customer")
    return run_sql(spark, {"o_view": orders, "c_view": customer}, """
        SELECT c.c_mktsegment AS segment, COUNT(*) AS n_orders,
               CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
        FROM o_view o JOIN c_view c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment""")


# ------------------------------------------------------------------- profiling

_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(table: str, cols, group: str | None = None) -> str:
    """Oracle for ``describe`` over 2-decimal money columns: mean and sample
    std from exact decimal sums, quartiles by linear interpolation."""
    def d(c):
        return f"CAST({c} AS DECIMAL(18,2))"

    def mom(c):
        n = f"CAST(COUNT({c}) AS DOUBLE)"
        s1 = f"CAST(SUM({d(c)}) AS DOUBLE)"
        s2 = f"CAST(SUM({d(c)} * {d(c)}) AS DOUBLE)"
        return {"count": n, "mean": f"{s1} / {n}",
                "std": f"CASE WHEN {n} > 1 THEN sqrt(greatest(({s2} - {s1} * {s1} / {n}) / ({n} - 1), 0.0)) END"}
    parts = []
    for c in cols:
        m = mom(c)
        x = f"CAST({d(c)} AS DOUBLE)"  # the same 2-decimal values as doubles
        if group:
            parts.append(f"""
SELECT {group}, '{c}' AS "column",
  round({m['count']}, 6) AS "count", round({m['mean']}, 6) AS mean,
  round({m['std']}, 6) AS std, round(MIN({x}), 6) AS "min",
  round(QUANTILE_CONT({x}, 0.25), 6) AS p25, round(QUANTILE_CONT({x}, 0.5), 6) AS p50,
  round(QUANTILE_CONT({x}, 0.75), 6) AS p75, round(MAX({x}), 6) AS "max"
FROM {table} GROUP BY {group}""")
        else:
            for name, e in (("count", m["count"]), ("mean", m["mean"]), ("std", m["std"]),
                            ("min", f"MIN({x})"), ("p25", f"QUANTILE_CONT({x}, 0.25)"),
                            ("p50", f"QUANTILE_CONT({x}, 0.5)"), ("p75", f"QUANTILE_CONT({x}, 0.75)"),
                            ("max", f"MAX({x})")):
                parts.append(f"SELECT '{c}' AS \"column\", '{name}' AS metric, "
                             f"round(CAST({e} AS DOUBLE), 6) AS value FROM {table}")
    return "\nUNION ALL\n".join(parts)


@query("profile_describe", _describe_sql("lineitem", _DESC_COLS))
def profile_describe(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    money_cols = li.select(*[C.money(c).alias(c) for c in _DESC_COLS])  # 2-decimal amounts
    return P.describe(money_cols, _DESC_COLS).withColumn("value", F.round("value", 6))


@query("describe_by_group", _describe_sql("events", ["value"], group="event_type"))
def describe_by_group(spark, sf):
    (ev,) = tables(spark, sf, "events")
    d = P.describe_by_group(ev.select("event_type", C.money("value").alias("value")), "event_type", ["value"])
    return d.select("event_type", "column", *[F.round(m, 6).alias(m) for m in P._STATS])


_NULLY_SQL = """(SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg,
  CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS bal, c_nationkey FROM customer)"""


def _nully(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return c.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"),
                    F.when(F.col("c_acctbal") < 0, None).otherwise(F.col("c_acctbal")).alias("bal"),
                    "c_nationkey")


@query("null_counts", f"""
SELECT COUNT(*) FILTER (WHERE c_custkey IS NULL) AS c_custkey,
       COUNT(*) FILTER (WHERE seg IS NULL) AS seg,
       COUNT(*) FILTER (WHERE bal IS NULL) AS bal,
       COUNT(*) FILTER (WHERE c_nationkey IS NULL) AS c_nationkey,
       COUNT(*) FILTER (WHERE c_custkey IS NULL) + COUNT(*) FILTER (WHERE seg IS NULL)
       + COUNT(*) FILTER (WHERE bal IS NULL) + COUNT(*) FILTER (WHERE c_nationkey IS NULL) AS total_nulls
FROM {_NULLY_SQL}""")
def null_counts(spark, sf):
    return P.null_counts(_nully(spark, sf))


@query("nonnull_cells_where", f"""
SELECT COUNT(c_custkey) + COUNT(seg) + COUNT(bal) + COUNT(c_nationkey) AS nonnull_cells
FROM {_NULLY_SQL} WHERE c_nationkey < 10""")
def nonnull_cells(spark, sf):
    return P.nonnull_cells_where(_nully(spark, sf), "c_nationkey < 10")


@query("profile_info", f"""
SELECT * FROM (
  SELECT 0 AS position, 'c_custkey' AS "column", COUNT(c_custkey) AS non_null, COUNT(*) AS n_rows FROM {_NULLY_SQL}
  UNION ALL SELECT 1, 'seg', COUNT(seg), COUNT(*) FROM {_NULLY_SQL}
  UNION ALL SELECT 2, 'bal', COUNT(bal), COUNT(*) FROM {_NULLY_SQL}
  UNION ALL SELECT 3, 'c_nationkey', COUNT(c_nationkey), COUNT(*) FROM {_NULLY_SQL})""")
def profile_info(spark, sf):
    return P.info(_nully(spark, sf)).drop("dtype")


@query("distinct_values", "SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return P.distinct_values(o, "o_orderpriority")


@query("count_matches", "SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_matches FROM orders")
def count_matches(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return P.count_matches(o, "o_orderstatus", "F")


@query("class_balance", """
SELECT l_returnflag, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM lineitem GROUP BY l_returnflag""")
def class_balance(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return P.class_balance(li, "l_returnflag")


# ------------------------------------------------------------------ projection

@query("rename_map", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus, o_totalprice AS total,
       o_orderdate, o_orderpriority FROM orders""")
def rename_map(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return C.rename_map(o, {"o_orderkey": "order_id", "o_custkey": "customer_id",
                            "o_totalprice": "total", "not_a_column": "ignored"})


@query("replace_in_rows", """
SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' AND c_name = 'BUILDING' THEN 'NA' ELSE c_name END AS c_name,
  c_nationkey, c_acctbal,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'NA' ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def replace_in_rows(spark, sf):
    (c,) = tables(spark, sf, "customer")
    return C.replace_in_rows(c, F.col("c_mktsegment") == "BUILDING", {"BUILDING": "NA"})


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_columns(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return C.drop_columns(o, ["o_orderdate", "o_orderpriority", "o_comment_missing"])


@query("cast_columns", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pr,
       TRY_CAST(replace(o_orderpriority, '-URGENT', '') AS INTEGER) AS o_orderpriority,
       TRY_CAST(replace(o_orderstatus, 'F', '7') AS INTEGER) AS o_orderstatus
FROM orders""")
def cast_columns(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("pr"),
                 F.replace("o_orderpriority", F.lit("-URGENT"), F.lit("")).alias("o_orderpriority"),
                 F.replace("o_orderstatus", F.lit("F"), F.lit("7")).alias("o_orderstatus"))
    return C.cast_columns(x, ["pr", "o_orderpriority", "o_orderstatus"], "int")


_BN_SQL = ("(CAST(strftime(o_orderdate, '%y%m%d') AS INTEGER) + "
           "CASE WHEN o_orderstatus = 'F' THEN 5000 ELSE 0 END)")


def _birth_numbers(spark, sf):
    (o,) = tables(spark, sf, "orders")
    bn = (F.date_format("o_orderdate", "yyMMdd").cast("int") +
          F.when(F.col("o_orderstatus") == "F", 5000).otherwise(0))
    return o.where(F.col("o_orderdate") < F.to_date(F.lit("2000-01-01"))).select(
        "o_orderkey", bn.alias("birth_number"))


@query("decode_birth_number", f"""
SELECT o_orderkey, bn AS birth_number, 1900 + yy AS birth_year,
  CASE WHEN mm > 50 THEN mm - 50 ELSE mm END AS birth_month, dd AS birth_day,
  CASE WHEN mm > 50 THEN 'F' ELSE 'M' END AS sex, 2005 - (1900 + yy) AS age
FROM (SELECT o_orderkey, bn, CAST(substr(s, 1, 2) AS INTEGER) AS yy,
        CAST(substr(s, 3, 2) AS INTEGER) AS mm, CAST(substr(s, 5, 2) AS INTEGER) AS dd
      FROM (SELECT o_orderkey, {_BN_SQL} AS bn, lpad(CAST({_BN_SQL} AS VARCHAR), 6, '0') AS s
            FROM orders WHERE o_orderdate < DATE '2000-01-01'))""")
def q_decode_birth_number(spark, sf):
    b = _birth_numbers(spark, sf)
    d = decode_birth_number("birth_number", eval_year=2005)
    return b.select("o_orderkey", "birth_number",
                    *[d[k].alias(k) for k in ("birth_year", "birth_month", "birth_day", "sex", "age")])


@query("age_band", f"""
SELECT o_orderkey, CAST(floor((2005 - (1900 + CAST(substr(lpad(CAST({_BN_SQL} AS VARCHAR), 6, '0'), 1, 2) AS INTEGER))) / 10) * 10 AS INTEGER) AS age_group
FROM orders WHERE o_orderdate < DATE '2000-01-01'""")
def q_age_band(spark, sf):
    b = _birth_numbers(spark, sf)
    d = decode_birth_number("birth_number", eval_year=2005)
    return b.select("o_orderkey", C.age_band(d["age"]).alias("age_group"))


_QCOLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("row_sum_quarters", """
SELECT l_orderkey, l_linenumber,
  CAST(CAST(l_quantity AS DECIMAL(18,2)) + CAST(l_extendedprice AS DECIMAL(18,2))
     + CAST(l_discount AS DECIMAL(18,2)) + CAST(l_tax AS DECIMAL(18,2)) AS DOUBLE) AS row_total
FROM lineitem""")
def row_sum_quarters(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     C.row_sum([C.money(c) for c in _QCOLS]).cast("double").alias("row_total"))


@query("row_count_positive", """
SELECT l_orderkey, l_linenumber,
  CAST(l_quantity > 0 AS INTEGER) + CAST(l_extendedprice > 0 AS INTEGER)
  + CAST(l_discount > 0 AS INTEGER) + CAST(l_tax > 0 AS INTEGER) AS n_positive
FROM lineitem""")
def row_count_positive(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", C.row_count_positive(_QCOLS).alias("n_positive"))


# --------------------------------------------------------------------- filters

@query("asof_filter", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < DATE '1998-09-01'""")
def asof_filter(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return FL.as_of(o, "o_orderdate", before="1998-08-31").select("o_orderkey", "o_orderdate")


@query("asof_filter_after", """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '1998-09-01'""")
def asof_filter_after(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return FL.as_of(o, "o_orderdate", after="1998-09-01").select("o_orderkey", "o_orderdate")


@query("filter_not_null", f"SELECT * FROM {_NULLY_SQL} WHERE seg IS NOT NULL AND bal IS NOT NULL")
def filter_not_null(spark, sf):
    return FL.filter_not_null(_nully(spark, sf), ["seg", "bal"])


@query("filter_expr", """
SELECT l_orderkey, l_linenumber, l_discount FROM lineitem
WHERE l_returnflag = 'R' AND l_discount >= 0.05""")
def filter_expr(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return FL.filter_expr(li, "l_returnflag = 'R' AND l_discount >= 0.05") \
        .select("l_orderkey", "l_linenumber", "l_discount")


@query("filter_isin", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filter_isin(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return FL.filter_isin(o, "o_orderpriority", ["1-URGENT", "2-HIGH"]) \
        .select("o_orderkey", "o_orderpriority")


# ------------------------------------------------------------- scalar functions

# bank-style transaction codes derived from the orders table
_TYPE_CODE = {"F": "PRIJEM", "O": "VYDAJ"}
_OP_CODE = {"1-URGENT": "VYBER KARTOU", "2-HIGH": "VKLAD", "3-MEDIUM": "PREVOD Z UCTU",
            "4-NOT SPECIFIED": "VYBER"}


def _case_sql(col, mapping, default="NULL", quote_default=False):
    d = f"'{default}'" if quote_default else default
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {d} END"


@query("recode_default", f"""
SELECT o_orderkey,
  {_case_sql(_case_sql('o_orderstatus', _TYPE_CODE), TRANS_TYPE, TRANS_TYPE_DEFAULT, True)} AS type,
  {_case_sql(_case_sql('o_orderpriority', _OP_CODE), TRANS_OPERATION, TRANS_OPERATION_DEFAULT, True)} AS operation
FROM orders""")
def recode_default(spark, sf):
    (o,) = tables(spark, sf, "orders")
    t = recode("o_orderstatus", _TYPE_CODE)
    op = recode("o_orderpriority", _OP_CODE)
    return o.select("o_orderkey", recode(t, TRANS_TYPE, TRANS_TYPE_DEFAULT).alias("type"),
                    recode(op, TRANS_OPERATION, TRANS_OPERATION_DEFAULT).alias("operation"))


@query("recode_passthrough", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linestatus = 'N' THEN 0 WHEN l_linestatus = 'F' THEN 1
       ELSE TRY_CAST(l_linestatus AS INTEGER) END AS language,
  CASE WHEN CAST(l_linenumber AS VARCHAR) = '1' THEN 'NA' ELSE CAST(l_linenumber AS VARCHAR) END AS camp_id
FROM lineitem""")
def q_recode_passthrough(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     recode_passthrough("l_linestatus", LANGUAGE, cast="int").alias("language"),
                     recode_passthrough(F.col("l_linenumber").cast("string"), {"1": "NA"}).alias("camp_id"))


@query("bucket_ranges", f"""
SELECT p_partkey, p_size * 200 AS zip,
  {_sql_ranges('p_size * 200', PROVINCE_BREAKS, 1000, 'Missing')} AS province,
  {_sql_ranges('p_size * 200', REGION_BREAKS, 1000, 'Missing')} AS region
FROM part""")
def q_bucket_ranges(spark, sf):
    (p,) = tables(spark, sf, "part")
    z = F.col("p_size") * 200
    return p.select("p_partkey", z.alias("zip"), province(z).alias("province"),
                    region(z).alias("region"))


@query("parse_yymmdd", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%y%m%d') AS INTEGER) AS yymmdd,
       CAST(o_orderdate AS DATE) AS parsed
FROM orders WHERE o_orderdate < DATE '2000-01-01'""")
def q_parse_yymmdd(spark, sf):
    (o,) = tables(spark, sf, "orders")
    y = F.date_format("o_orderdate", "yyMMdd").cast("int")
    return o.where(F.col("o_orderdate") < F.to_date(F.lit("2000-01-01"))) \
        .select("o_orderkey", y.alias("yymmdd"), parse_yymmdd(y).alias("parsed"))


@query("parse_compact_ts", """
SELECT event_id, strptime('19' || strftime(ts, '%y%m%d %H:%M:%S'), '%Y%m%d %H:%M:%S') AS issued
FROM events""")
def q_parse_compact_ts(spark, sf):
    (ev,) = tables(spark, sf, "events")
    return ev.select("event_id", parse_compact_ts(F.date_format("ts", "yyMMdd HH:mm:ss")).alias("issued"))


@query("days_between", """
SELECT l.l_orderkey, l.l_linenumber,
  CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS INTEGER) AS ship_days,
  CAST(date_diff('day', CAST(l.l_shipdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days_to_eval
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_days_between(spark, sf):
    li, o = tables(spark, sf, "lineitem", "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    days_between("l_shipdate", "o_orderdate").alias("ship_days"),
                    days_between("1999-01-01", "l_shipdate").alias("days_to_eval"))


@query("months_between", """
SELECT l_orderkey, l_linenumber, round(
  (year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate)
  + CASE WHEN day(l_shipdate) = day(o_orderdate)
           OR (CAST(l_shipdate AS DATE) = last_day(l_shipdate) AND CAST(o_orderdate AS DATE) = last_day(o_orderdate))
         THEN 0 ELSE (day(l_shipdate) - day(o_orderdate)) / 31.0 END, 8) AS months
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def q_months_between(spark, sf):
    li, o = tables(spark, sf, "lineitem", "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber", months_between("l_shipdate", "o_orderdate").alias("months"))


@query("clean_zip", """
SELECT c_custkey, COALESCE(TRY_CAST(replace(replace(zipcode, 'SW6 3PS', '0'), ' ', '0') AS INTEGER), 0) AS zip
FROM (SELECT c_custkey,
    CASE WHEN c_mktsegment = 'BUILDING' THEN NULL
         WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 1 THEN 'SW6 3PS'
         ELSE (CASE WHEN length(zs) < 4 THEN lpad(zs, 4, ' ') ELSE zs END) END AS zipcode
  FROM (SELECT *, CAST(CAST(floor(abs(c_acctbal) * 1.5) AS INTEGER) AS VARCHAR) AS zs FROM customer))""")
def q_clean_zip(spark, sf):
    (c,) = tables(spark, sf, "customer")
    z = D.dirty_zip(c)
    return z.select(F.col("donor_id").alias("c_custkey"), clean_zip("zipcode").alias("zip"))


@query("fill_nulls", f"""
SELECT c_custkey, seg, COALESCE(bal, 0) AS bal, c_nationkey FROM {_NULLY_SQL}""")
def fill_nulls(spark, sf):
    return C.fill_nulls(_nully(spark, sf), 0)


@query("flag_threshold", """
SELECT o_orderkey, CASE WHEN p > 150000 THEN 1 ELSE 0 END AS high_value
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS p FROM orders)""")
def flag_threshold(spark, sf):
    (o,) = tables(spark, sf, "orders")
    p = F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", flag(p > 150000).alias("high_value"))


@query("url_template", f"""
SELECT o_orderkey, '{MARKET_URL_PREFIX}' || strftime(o_orderdate, '%Y-%m-%d') || '{MARKET_URL_SUFFIX}' AS url
FROM orders""")
def url_template(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return o.select("o_orderkey", market_url("o_orderdate").alias("url"))


_KW = {"signup": "yesterday", "view": "today", "click": "tomorrow", "purchase": "someday"}


@query("relative_date", f"""
SELECT event_id, CASE kw WHEN 'today' THEN CAST(ts AS DATE)
                         WHEN 'yesterday' THEN CAST(CAST(ts AS DATE) - INTERVAL 1 DAY AS DATE)
                         WHEN 'tomorrow' THEN CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS DATE) END AS delivery_date
FROM (SELECT event_id, ts, {_case_sql('event_type', _KW)} AS kw FROM events)""")
def q_relative_date(spark, sf):
    (ev,) = tables(spark, sf, "events")
    kw = recode("event_type", _KW)
    return ev.select("event_id", relative_date(kw, F.to_date("ts")).alias("delivery_date"))
