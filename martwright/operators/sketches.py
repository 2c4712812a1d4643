"""Stored, mergeable profiles: one row per slice of a table and column.

A profile holds what sums and merges: count, sum, sum of squares, extremes and a KLL
sketch of the values.  It is kept beside the data (a row for each slice and column);
any range or group of slices is then described by merging profiles, without another scan
of the rows.  Ranks from a sketch are off by at most ``rank_error(k)`` of the rows (a
bound that holds with probability 0.99), merged or not.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: size of the sketches: a few tens of kilobytes each
K = 1_600


def rank_error(k: int = K) -> float:
    """Bound of a single rank's error, as a share of the rows (the sketch's published fit, with room)."""
    return 2.296 / k ** 0.9723


def profiles(df: DataFrame, slice_by: Mapping[str, Column], columns: Sequence[str], k: int = K) -> DataFrame:
    """``<slices>..., column, n, s, q, lo, hi, sketch``: one partial aggregate over the
    long form of the columns; nulls and NaN are left out, columns without values have no row."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(*[e.alias(n) for n, e in slice_by.items()], F.explode(cells).alias("_c")).select(
        *slice_by, "_c.column", "_c.v").where("v is not null and not isnan(v)")
    v = F.col("v")
    return long.groupBy(*slice_by, "column").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.kll_sketch_agg_double(v, k).alias("sketch"))


def describe_profiles(stored: DataFrame, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """``<by>..., column, count, mean, std, min, <probs>..., max`` from stored profiles,
    merged over all slices of a group (filter the profiles for a range)."""
    merged = stored.groupBy(*by, "column").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.kll_merge_agg_double("sketch").alias("sketch"))
    n, s = F.col("n"), F.col("s")
    std = F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - s * s / n) / (n - 1))))
    at = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return merged.select(*by, "column", n.alias("count"), (s / n).alias("mean"), std.alias("std"), F.col("lo").alias("min"),
                         *at, F.col("hi").alias("max"))
