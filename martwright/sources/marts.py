"""Marts as stored tables: partitioned by as-of date, bucketed by entity.

Tables bucketed alike on the entity join without moving a row, whatever is joined
later (predictions, segments); a rewritten as-of date replaces its own partition and
leaves the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "as_of"


def save_mart(df: DataFrame, name: str, key: str, as_of: str, path: str, buckets: int = 64) -> None:
    """Write the rows of one as-of date into the table (made at ``path`` if it does not
    exist), in place of those it holds of that date."""
    spark = df.sparkSession
    rows = df.select("*", F.to_date(F.lit(as_of)).alias(DATE))
    # one file a bucket: the rows are dealt out by the bucketing hash first
    rows = rows.repartition(buckets, key)
    if not spark.catalog.tableExists(name):
        rows.write.partitionBy(DATE).bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
        return
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        columns = spark.table(name).columns
        rows.select(*[F.col(f"`{c}`") for c in columns]).write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def read_mart(spark: SparkSession, name: str, as_of: str | None = None) -> DataFrame:
    """The table, or the rows of one as-of date (only that partition is read)."""
    t = spark.table(name)
    return t if as_of is None else t.where(F.col(DATE) == F.to_date(F.lit(as_of))).drop(DATE)
