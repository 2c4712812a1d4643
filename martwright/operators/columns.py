"""Projection operators: rename, drop, cast, derive, row-wise sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by map; keys that are not columns are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def replace_in_rows(df: DataFrame, predicate: Column | str, mapping: Mapping[str, str],
                    columns: Sequence[str] | None = None) -> DataFrame:
    """Whole-cell replacement ``old -> new`` in every string column (or the
    given ones), only in rows matching ``predicate``; other rows untouched."""
    from pyspark.sql.types import StringType
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    targets = set(columns) if columns else {f.name for f in df.schema.fields
                                            if isinstance(f.dataType, StringType)}
    out = []
    for name in df.columns:
        x = F.col(f"`{name}`")
        if name in targets:
            e = x
            for old, new in mapping.items():
                e = F.when(F.coalesce(pred, F.lit(False)) & (x == F.lit(old)), F.lit(new)).otherwise(e)
            x = e.alias(name)
        out.append(x)
    return df.select(*out)


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def cast_columns(df: DataFrame, names: Sequence[str], to: str) -> DataFrame:
    """Cast a list of columns in ONE projection; bad values become null."""
    from pyspark.sql.types import StringType

    from ..functions.recode import try_cast_str
    targets = set(names)
    out = []
    for f in df.schema.fields:
        x = F.col(f"`{f.name}`")
        if f.name in targets:
            x = try_cast_str(x, to) if isinstance(f.dataType, StringType) else x.try_cast(to)
            x = x.alias(f.name)
        out.append(x)
    return df.select(*out)


def row_sum(cols: Sequence[str | Column], null_as_zero: bool = True) -> Column:
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    if null_as_zero:
        cs = [F.coalesce(c, F.lit(0)) for c in cs]
    return sum(cs[1:], cs[0])


def row_count_positive(cols: Sequence[str | Column]) -> Column:
    """Number of cells > 0 in the row (null counts as not positive)."""
    cs = [F.col(c) if isinstance(c, str) else c for c in cols]
    flags = [F.coalesce((c > 0).cast("int"), F.lit(0)) for c in cs]
    return sum(flags[1:], flags[0])


def age_band(age: str | Column, width: int = 10) -> Column:
    a = F.col(age) if isinstance(age, str) else age
    return (F.floor(a / F.lit(width)) * F.lit(width)).cast("int")


def fill_nulls(df: DataFrame, value=0, subset: Sequence[str] | None = None) -> DataFrame:
    """Numeric-only fill (strings and dates keep their nulls)."""
    return df.na.fill(value, subset=list(subset) if subset else None)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double (after exact decimal sums)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[(F.col(f"`{f.name}`").cast("double").alias(f.name)
                        if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`"))
                       for f in df.schema.fields])


def money(c: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """Amount as decimal so that sums are exact and order-independent."""
    x = F.col(c) if isinstance(c, str) else c
    return x.cast(f"decimal({precision},{scale})")
