"""SQL text over the frames in scope, and literal rows as a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, frames: Mapping[str, DataFrame], query: str,
            args: Mapping | None = None) -> DataFrame:
    """Register each frame as a temp view under its key and run ``query``.

    Catalyst plans the SQL exactly as it would the DataFrame calls, so the
    views cost nothing until an action runs.
    """
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=dict(args) if args else None)


def rows_to_frame(spark: SparkSession, rows: Sequence, schema) -> DataFrame:
    """Small literal table (metric rows, fixtures) with a declared schema."""
    return spark.createDataFrame(list(rows), schema)
