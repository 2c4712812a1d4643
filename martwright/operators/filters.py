"""Row filters: as-of splits, not-null, SQL predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_of(df: DataFrame, date_col: str, before: str | None = None,
          after: str | None = None) -> DataFrame:
    """``date <= before`` (training) and/or ``date >= after`` (scoring).

    Comparing the column itself (not ``to_date(column)``) keeps the
    predicate pushable into the parquet scan.
    """
    d = F.col(date_col)
    if before is not None:
        df = df.where(d < F.date_add(F.to_date(F.lit(before)), 1))
    if after is not None:
        df = df.where(d >= F.to_date(F.lit(after)))
    return df


def filter_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return df.where(cond)


def filter_expr(df: DataFrame, predicate: str | Column) -> DataFrame:
    return df.where(predicate)


def filter_isin(df: DataFrame, c: str, values: Sequence) -> DataFrame:
    return df.where(F.col(c).isin(list(values)))
