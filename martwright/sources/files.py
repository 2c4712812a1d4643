"""File scans and sinks (CSV with either separator, parquet).

Schemas are always declared: inference costs a full extra scan per file and
drifts between files, so ``infer_schema`` is an explicit opt-in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             sep: str = ",", header: bool = True, infer_schema: bool = False,
             date_format: str | None = None,
             timestamp_format: str | None = None) -> DataFrame:
    """CSV scan with a declared schema; ``sep=';'`` for the semicolon files.

    Malformed cells become null (PERMISSIVE) instead of failing the job, which
    matches how the reference coerces unparsable numbers.
    """
    r = spark.read.option("header", header).option("sep", sep) \
        .option("mode", "PERMISSIVE").option("nullValue", "")
    if date_format:
        r = r.option("dateFormat", date_format)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    if schema is not None:
        r = r.schema(schema)
    elif infer_schema:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite",
              header: bool = True) -> None:
    """CSV sink: one file per partition, header per file, no row index."""
    df.write.mode(mode).option("header", header).option("sep", sep).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> None:
    """Parquet sink, the default format for marts."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
