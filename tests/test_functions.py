"""Scalar functions on literal edge rows."""

import datetime as dt

from pyspark.sql import functions as F

from martwright.functions import (bucket_ranges, clean_zip, decode_birth_number, flag,
                                  parse_compact_ts, parse_yymmdd, province, recode,
                                  recode_passthrough, region, relative_date)
from martwright.functions.recode import TRANS_OPERATION, TRANS_OPERATION_DEFAULT


def test_zip_ranges_fall_through(spark):
    df = spark.createDataFrame([(z,) for z in [None, 0, 999, 1000, 1299, 1300, 9999, 10000]], "z int")
    out = {r.z: (r.p, r.r) for r in df.select("z", province("z").alias("p"), region("z").alias("r")).collect()}
    assert out[0] == ("Walloon Brabant", "Wallonia")  # < 1000 falls to the second range
    assert out[999] == ("Walloon Brabant", "Wallonia")
    assert out[1000] == ("Brussels", "Brussels")
    assert out[1299] == ("Brussels", "Brussels")
    assert out[1300] == ("Walloon Brabant", "Wallonia")
    assert out[9999] == ("East Flanders", "Flanders")
    assert out[10000] == ("Missing", "Missing")
    assert out[None] == ("Missing", "Missing")


def test_clean_zip(spark):
    df = spark.createDataFrame([("SW6 3PS",), (" 999",), (None,), ("1 00",), ("abc",), ("1300",)], "z string")
    got = [r[0] for r in df.select(clean_zip("z")).collect()]
    assert got == [0, 999, 0, 1000, 0, 1300]


def test_birth_number(spark):
    df = spark.createDataFrame([(706213,), (51212,), (451231,)], "bn int")
    d = decode_birth_number("bn", eval_year=1999)
    rows = df.select(*[d[k].alias(k) for k in ("birth_year", "birth_month", "birth_day", "sex", "age", "age_group")]).collect()
    assert tuple(rows[0]) == (1970, 12, 13, "F", 29, 20)   # month 62 = December, woman
    assert tuple(rows[1]) == (1905, 12, 12, "M", 94, 90)   # leading zero lost in the int
    assert tuple(rows[2]) == (1945, 12, 31, "M", 54, 50)


def test_compact_ts_bad_text_is_null(spark):
    df = spark.createDataFrame([("931345 10:00:00",), ("garbage",), ("930101 24:00:00",)], "t string")
    assert [r[0] for r in df.select(parse_compact_ts("t")).collect()] == [None, None, None]


def test_yymmdd_and_compact_ts(spark):
    df = spark.createDataFrame([(930101, "930101 10:11:12"), (50307, "050307 00:00:00"), (None, None)],
                               "d int, t string")
    r = df.select(parse_yymmdd("d").alias("d"), parse_compact_ts("t").alias("t")).collect()
    assert r[0].d == dt.date(1993, 1, 1) and r[0].t == dt.datetime(1993, 1, 1, 10, 11, 12)
    assert r[1].d == dt.date(1905, 3, 7)
    assert r[2].d is None


def test_recode_defaults_and_passthrough(spark):
    df = spark.createDataFrame([("VYBER",), ("XX",), (None,)], "c string")
    got = [r[0] for r in df.select(recode("c", TRANS_OPERATION, TRANS_OPERATION_DEFAULT)).collect()]
    assert got == ["Cash_withdrawl", "Other_Operations", "Other_Operations"]
    lang = spark.createDataFrame([("N",), ("F",), ("Q",)], "c string")
    assert [r[0] for r in lang.select(recode_passthrough("c", {"N": 0, "F": 1}, cast="int")).collect()] == [0, 1, None]


def test_flag_null_is_zero(spark):
    df = spark.createDataFrame([(35.0,), (35.01,), (None,)], "a double")
    assert [r[0] for r in df.select(flag(F.col("a") > 35)).collect()] == [0, 1, 0]


def test_relative_date(spark):
    df = spark.createDataFrame([("today",), ("Yesterday",), ("tomorrow",), ("later",)], "k string")
    a = F.to_date(F.lit("2019-12-14"))
    got = [r[0] for r in df.select(relative_date("k", a)).collect()]
    assert got == [dt.date(2019, 12, 14), dt.date(2019, 12, 13), dt.date(2019, 12, 15), None]


def test_bucket_ranges_generic(spark):
    df = spark.createDataFrame([(1,), (5,), (20,)], "x int")
    got = [r[0] for r in df.select(bucket_ranges("x", [(2, "a"), (10, "b")], "c")).collect()]
    assert got == ["a", "b", "c"]


def test_null_keys_dropped_and_numeric_only_fill(spark):
    from martwright.operators.aggregate import entity_aggregates
    from martwright.operators.columns import fill_nulls
    df = spark.createDataFrame([(1, 2.0, "a"), (None, 5.0, None), (1, float("nan"), None), (2, None, "b")],
                               "k int, x double, s string")
    agg = {r.k: r.count_x for r in entity_aggregates(df, "k", {"x": ["count"]}).collect()}
    assert agg == {1: 2, 2: 0}                      # the null key is not a group
    ided = df.withColumn("id", F.monotonically_increasing_id())
    filled = sorted(fill_nulls(ided, 0, subset=["x", "s"]).collect(), key=lambda r: r.id)
    assert [r.x for r in filled] == [2.0, 5.0, 0.0, 0.0]   # NaN and null -> 0
    assert [r.s for r in filled] == ["a", None, None, "b"]  # strings keep their nulls


def test_pivot_absent_category_and_ties_in_top_k(spark):
    from martwright.operators.aggregate import pivot_agg
    from martwright.operators.ordering import top_k
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 3.0), (2, "y", 4.0)], "k int, c string, v double")
    p = {r.k: (r.sum_x, r.sum_y, r.n_x) for r in pivot_agg(
        df, "k", "c", [("sum", "v", "sum"), ("count", "v", "n")], values=["x", "y"]).collect()}
    assert p == {1: (5.0, None, 2), 2: (None, 4.0, 0)}      # absent: null sum, zero count
    t = spark.createDataFrame([(i, 1.0) for i in range(5)], "id int, s double")
    assert [r.id for r in top_k(t, [("s", True), ("id", False)], 3).collect()] == [0, 1, 2]
