"""Joins and star-chain mart assembly.

Join strategy is left to Spark: with AQE on, a side whose *materialised*
size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold`` is
broadcast at runtime, anything larger stays a sort-merge join.  That is the
size check; no join here carries a broadcast hint.  Feature frames are aggregates keyed on the
entity, so they are already hash-partitioned on the join key and a chain of
left joins on that key adds no exchange beyond the base's own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_left(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left outer join by key name(s); the key appears once in the output."""
    return left.join(right, on=on, how="left")


def join_inner(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(right, on=on, how="inner")


def assert_unique(df: DataFrame, keys: str | Sequence[str], what: str = "frame") -> None:
    """Fail if any key value occurs twice (one distributed aggregate; only a
    single offending key is brought back)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    dup = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{what} is not unique on {keys}: e.g. {dup[0].asDict()}")


def build_mart(base: DataFrame, features: Sequence[tuple[DataFrame, str | Sequence[str]]],
               fill: float | int | None = 0, fanout: str = "allow",
               fill_subset: Sequence[str] | None = None) -> DataFrame:
    """``base`` left-joined with each ``(frame, keys)``, then numeric nulls -> ``fill``.

    ``fanout='reject'`` checks each feature frame is unique on its keys
    (one aggregate job per frame) so the mart keeps one row per base row.
    Column names must not collide apart from the keys.
    """
    seen = set(base.columns)
    for df, keys in features:
        ks = {keys} if isinstance(keys, str) else set(keys)
        clash = (set(df.columns) - ks) & seen
        if clash:
            raise ValueError(f"column clash in mart assembly: {sorted(clash)}")
        seen |= set(df.columns)
        if fanout == "reject":
            assert_unique(df, keys, "feature frame")
    mart = reduce(lambda acc, fk: acc.join(fk[0], on=fk[1], how="left"), features, base)
    if fill is not None:
        mart = mart.na.fill(fill, subset=list(fill_subset) if fill_subset else None)
    return mart
