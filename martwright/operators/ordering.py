"""Sort, top-k, arg-max and union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, order: Sequence[tuple[str, bool]], k: int) -> DataFrame:
    """First ``k`` rows by ``order`` = [(column, descending)]; include a
    unique tie-break column so the result is deterministic.  Spark plans
    ``orderBy + limit`` as TakeOrderedAndProject: each task keeps k rows."""
    cols = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in order]
    return df.orderBy(*cols).limit(k)


def arg_max(df: DataFrame, target: str, by: str, group: str | None = None) -> DataFrame:
    """Value of ``target`` at the maximum of ``by`` (per ``group``); a
    partial aggregate, no sort."""
    agg = [F.max_by(target, by).alias(f"{target}_at_max"), F.max(by).alias(f"max_{by}")]
    return df.groupBy(group).agg(*agg) if group else df.agg(*agg)


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Append by column name (never by position)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
