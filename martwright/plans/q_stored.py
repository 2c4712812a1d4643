"""Catalogue: checked CSV reads, stored marts, stored profiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..operators import sketches as SK
from ..session import checkpoint_dir
from ..sources.checked import read_csv_checked
from ..sources.marts import read_mart, save_mart
from .catalog import query, tables

_CHECKED = StructType([StructField("o_orderkey", LongType()), StructField("o_totalprice", DoubleType()), StructField("o_orderstatus", StringType())])


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_quarantine", """
SELECT CASE o_orderkey % 10 WHEN 3 THEN 'short' WHEN 5 THEN 'long' WHEN 7 THEN 'type' ELSE 'good' END AS kind,
       count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 10 IN (3, 5, 7) THEN 0 ELSE o_orderkey END) AS BIGINT) AS keys
FROM orders GROUP BY 1""")
def csv_quarantine(spark, sf):
    """Orders written as lines, three of ten spoilt (a field missing, one too many, a price
    that is no number); read back as rows and rejects, counted by reason."""
    (o,) = tables(spark, sf, "orders")
    key, price, status = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.col("o_orderstatus")
    kind = F.col("o_orderkey") % 10
    line = (F.when(kind == 3, F.concat_ws(";", key, price)).when(kind == 5, F.concat_ws(";", key, price, status, F.lit("more")))
            .when(kind == 7, F.concat_ws(";", key, F.lit("no price"), status)).otherwise(F.concat_ws(";", key, price, status)))
    path = _folder(spark, "csv-checked")
    o.select(line.alias("value")).write.text(path)
    good, rejects = read_csv_checked(spark, path, _CHECKED, sep=";", header=False)
    return good.agg(F.lit("good").alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).unionByName(
        rejects.groupBy(F.col("reason").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("keys")))


def _by_customer(o, before: str):
    return o.where((F.col("o_orderdate") < F.to_date(F.lit(before))) & F.col("o_custkey").isNotNull()).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("mart_stored", """
SELECT CAST(d AS VARCHAR) AS as_of, o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN (VALUES (DATE '1997-01-01'), (DATE '1999-01-01')) t(d) ON o_orderdate < d
WHERE o_custkey IS NOT NULL GROUP BY d, o_custkey""")
def mart_stored(spark, sf):
    """A mart stored for two as-of dates, the first written wrongly and then anew: the
    rewrite replaces its own partition only."""
    (o,) = tables(spark, sf, "orders")
    name = f"mart_{uuid.uuid4().hex}"
    path = _folder(spark, "mart")
    save_mart(_by_customer(o, "1996-01-01"), name, "o_custkey", "1997-01-01", path, buckets=8)
    save_mart(_by_customer(o, "1999-01-01"), name, "o_custkey", "1999-01-01", path, buckets=8)
    save_mart(_by_customer(o, "1997-01-01"), name, "o_custkey", "1997-01-01", path, buckets=8)
    return read_mart(spark, name).select(F.col("as_of").cast("string").alias("as_of"), "o_custkey", "n_orders", "total")


@query("describe_stored")
def describe_stored(spark, sf):
    """Order prices described per year and status from profiles kept per month and status."""
    (o,) = tables(spark, sf, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    path = _folder(spark, "profiles")
    SK.profiles(o, {"month": month, "status": F.col("o_orderstatus")}, ["o_totalprice"]).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("year", F.substring("month", 1, 4))
    return SK.describe_profiles(stored, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["year", "status"])
