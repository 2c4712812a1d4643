"""Profiling as aggregates: one pass per question, long-format results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def info(df: DataFrame) -> DataFrame:
    """Per column: position, type, non-null count and row count (the
    ``info`` / ``shape`` part of an exploration), one aggregate pass."""
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("\u0001rows"),
                  *[F.count(F.col(f"`{c}`")).alias(f"\u0001{i}") for i, c in enumerate(cols)])
    recs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                     F.col(f"`\u0001{i}`").alias("non_null"), F.col("`\u0001rows`").alias("n_rows"))
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*recs)).alias("s")).select("s.*")


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: null count per column plus ``total_nulls``; a single scan."""
    cols = list(columns or df.columns)
    per = [F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    out = df.agg(*per)
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return out.select("*", total.alias("total_nulls"))


def nonnull_cells_where(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Non-null cells over all columns of the rows matching ``predicate``."""
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    cnts = [F.count(F.col(c)) for c in df.columns]
    return df.where(pred).agg(sum(cnts[1:], cnts[0]).alias("nonnull_cells"))


def distinct_values(df: DataFrame, c: str) -> DataFrame:
    return df.select(c).distinct()


def count_matches(df: DataFrame, c: str, value) -> DataFrame:
    return df.agg(F.count_if(F.col(c) == F.lit(value)).alias("n_matches"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and share of all rows.  The total is summed over the
    classes (one row each) after the only pass over the rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1))).cast("double")
    return g.select(label, "n", (F.col("n") / total).alias("share"))


_STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
_QS = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _plain_exprs(c: str, exact_decimal: bool = False) -> dict:
    """count, mean, sample std, min, max.  For decimal columns the mean and
    std come from exact decimal sums of x and x^2 (order-independent, so
    every engine and partitioning gives the same double)."""
    x = F.col(c).cast("double")
    if exact_decimal:
        d = F.col(c)
        n = F.count(d).cast("double")
        s1 = F.sum(d).cast("double")
        s2 = F.sum(d * d).cast("double")
        var = F.try_divide(s2 - s1 * s1 / n, n - 1)
        return {"count": n, "mean": F.try_divide(s1, n),
                "std": F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))),
                "min": F.min(x), "max": F.max(x)}
    return {"count": F.count(x).cast("double"), "mean": F.avg(x), "std": F.stddev_samp(x),
            "min": F.min(x), "max": F.max(x)}


def _is_decimal(df: DataFrame, c: str) -> bool:
    from pyspark.sql.types import DecimalType
    return isinstance(df.schema[c].dataType, DecimalType)


def _approx_exprs(c: str, accuracy: int) -> dict:
    x = F.col(c).cast("double")
    return {m: F.percentile_approx(x, p, accuracy) for m, p in _QS.items()}


def describe(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
             accuracy: int = 10000) -> DataFrame:
    """count/mean/std/min/quartiles/max of numeric columns, long format
    ``(column, metric, value)``.

    The moments are one aggregate over the table.  Exact quartiles come from
    ``operators.select`` (three more passes, no sort, no task holds a column's
    values); ``exact=False`` uses one ``percentile_approx`` sketch per column
    in the same aggregate.
    """
    cols = list(columns or numeric_columns(df))
    exprs = []
    for c in cols:
        e = _plain_exprs(c, _is_decimal(df, c))
        if not exact:
            e.update(_approx_exprs(c, accuracy))
        exprs += [x.alias(f"{c}\u0001{m}") for m, x in e.items()]
    wide = df.agg(*exprs)
    metrics = [m for m in _STATS if exact is False or m not in _QS]
    pairs = [F.struct(F.lit(c).alias("column"), F.lit(m).alias("metric"),
                      F.col(f"`{c}\u0001{m}`").cast("double").alias("value"))
             for c in cols for m in metrics]
    out = wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    if exact:
        # the result is one number per (column, quartile)
        from .select import interpolated_quantiles
        q = interpolated_quantiles(df, cols, list(_QS.values()))
        rows = [(c, m, q[(c, p)]) for c in cols for m, p in _QS.items()]
        out = out.unionByName(df.sparkSession.createDataFrame(
            rows, "column string, metric string, value double"))
    return out


def describe_by_group(df: DataFrame, group: str, columns: Sequence[str],
                      exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """``describe`` per group value (e.g. per cluster), one row per
    ``(group, column)`` with the eight statistics as columns.

    All columns share one aggregate.  Exact quartiles come from
    ``operators.select`` (brackets, then counted values), the same way for
    any number of groups; ``exact=False`` takes them from sketches in the
    same aggregate.
    """
    exprs = []
    for c in columns:
        e = _plain_exprs(c, _is_decimal(df, c))
        if not exact:
            e.update(_approx_exprs(c, accuracy))
        exprs += [x.cast("double").alias(f"{c}\u0001{m}") for m, x in e.items()]
    wide = df.groupBy(group).agg(*exprs)
    stats = [m for m in _STATS if not exact or m not in _QS]
    long = wide.select(group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}\u0001{m}`").alias(m) for m in stats])
        for c in columns])).alias("_s")).select(group, "_s.*")
    if exact:
        from .select import grouped_quantiles
        q = grouped_quantiles(df, group, columns, _QS)
        # null-safe on the group: a null group gets its quartiles too
        q = q.withColumnRenamed(group, "_qg").withColumnRenamed("column", "_qc")
        long = long.join(q, long[group].eqNullSafe(q["_qg"]) & (long["column"] == q["_qc"]), "left")
    return long.select(group, "column", *[F.col(m).cast("double").alias(m) for m in _STATS])


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def tail(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """Last ``n`` rows in ``order_by`` order (Spark has no row order)."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n)
