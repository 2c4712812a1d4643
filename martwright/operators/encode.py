"""Encoding and scaling: dummies, frequency index, winsorising, z-scores.

Fitted state (category lists, caps, means/stds) is always a tiny, bounded
result: a value list that names the output columns, one order statistic, or
one row of statistics.  Applying it is a projection with the fitted
values as literals, so transform never shuffles and never joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import safe_names


# ---------------------------------------------------------------------------
# dummies
# ---------------------------------------------------------------------------

def dummy_columns(c: str, values: Sequence, prefix: str | None = None,
                  drop_first: bool = False) -> list[Column]:
    """0/1 column per value (``<prefix>_<value>``); null input gives all 0.

    ``drop_first`` drops the first value of the sorted list, as pandas'
    ``get_dummies(drop_first=True)`` does.
    """
    prefix = c if prefix is None else prefix
    vals = sorted(v for v in values if v is not None)
    if drop_first:
        vals = vals[1:]
    x = F.col(c)
    named = safe_names(vals)
    return [F.coalesce((x == F.lit(v)).cast("int"), F.lit(0)).alias(
        f"{prefix}_{named[v]}" if prefix else named[v]) for v in vals]


def dummies(df: DataFrame, c: str, values: Sequence,
            prefix: str | None = None, drop_first: bool = False, drop_source: bool = True) -> DataFrame:
    """Append dummy columns for ``c``, one per value given."""
    keep = [x for x in df.columns if not (drop_source and x == c)]
    return df.select(*[F.col(f"`{x}`") for x in keep],
                     *dummy_columns(c, values, prefix, drop_first))


# ---------------------------------------------------------------------------
# frequency string index
# ---------------------------------------------------------------------------

def string_index(df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Index categories by descending frequency, ties by value (the order of
    ``StringIndexer(stringOrderType='frequencyDesc')``); null stays null.

    The label table is one partial aggregate (one row per category), ranked
    with the distributed ``global_rank`` (no single-task window even for
    high-cardinality columns) and joined back on the category; AQE
    broadcasts it at runtime when it is small.
    """
    from .ranking import global_rank
    out = out or f"{c}_index"
    freq = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    ranked = global_rank(freq, [("_n", True), (c, False)], "_rank")
    labels = ranked.select(c, (F.col("_rank") - 1).cast("double").alias(out))
    return df.join(labels, on=c, how="left")


# ---------------------------------------------------------------------------
# exact order statistic without a global sort (see operators.select)
# ---------------------------------------------------------------------------

def kth_smallest(df: DataFrame, c: str, k: int):
    """Exact k-th smallest (1-based) non-null value of ``c``
    (``operators.select``): partial aggregates, no sort."""
    from .select import column_stats, select_ranks
    st = column_stats(df, [c])
    n = st[c][0]
    if not n or k < 1 or k > n:
        return None
    return select_ranks(df, {c: [k]}, stats=st)[(c, k)]


def winsor_caps(df: DataFrame, columns: Sequence[str], upper: float = 0.01) -> dict:
    """``{column: cap}``: the order statistic at rank ``n - floor(upper * n)``
    (scipy rule), all columns in the same passes; None without values."""
    from .select import column_stats, select_ranks
    st = column_stats(df, columns)
    ranks = {c: st[c][0] - int(upper * st[c][0]) for c in columns if st[c][0]}
    found = select_ranks(df, {c: [k] for c, k in ranks.items()}, stats=st) if ranks else {}
    return {c: found[(c, ranks[c])] if c in ranks else None for c in columns}


def winsor_cap(df: DataFrame, c: str, upper: float = 0.01) -> float | None:
    return winsor_caps(df, [c], upper)[c]


def winsorize(df: DataFrame, columns: Sequence[str], upper: float = 0.01,
              suffix: str = "_w", caps: Mapping[str, float] | None = None,
              approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Clip each column at its upper cap into ``<c><suffix>`` (top only).

    ``approx=True`` takes the caps from one ``percentile_approx`` aggregate
    over all columns (bounded sketch, one pass) instead of the exact rule.
    """
    caps = dict(caps or {})
    missing = [c for c in columns if c not in caps]
    if missing and approx:
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 1 - upper, accuracy).alias(c)
                       for c in missing]).first()
        caps.update({c: row[c] for c in missing})
    else:
        caps.update(winsor_caps(df, missing, upper))
    out = [F.least(F.col(c).cast("double"), F.lit(caps[c])).alias(f"{c}{suffix}")
           for c in columns]
    return df.select("*", *out)


# ---------------------------------------------------------------------------
# z-scores
# ---------------------------------------------------------------------------

def zscore_fit(df: DataFrame, columns: Sequence[str], ddof: int = 0) -> DataFrame:
    """One-row frame ``<c>_mean, <c>_std`` (population std for ``ddof=0``)."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.agg(*[e for c in columns for e in
                    (F.avg(F.col(c).cast("double")).alias(f"{c}_mean"),
                     sd(F.col(c).cast("double")).alias(f"{c}_std"))])


def _stats_row(stats: DataFrame) -> dict:
    """The fitted statistics: one row, two numbers per column."""
    return stats.first().asDict()


def zscore_transform(df: DataFrame, stats: DataFrame | dict, columns: Sequence[str],
                     suffix: str = "_z") -> DataFrame:
    """``(x - mean) / std`` into ``<c><suffix>``; a constant column gives 0.

    The fitted means and stds are literals in the projection: transform is
    a map-only stage.
    """
    st = stats if isinstance(stats, dict) else _stats_row(stats)
    out = []
    for c in columns:
        m, s = st[f"{c}_mean"], st[f"{c}_std"]
        if s is None or s == 0:
            z = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            z = (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
        out.append(z.alias(f"{c}{suffix}"))
    return df.select("*", *out)


def zscore_inverse(df: DataFrame, stats: DataFrame | dict, columns: Sequence[str],
                   suffix: str = "_z", out_suffix: str = "_orig") -> DataFrame:
    """``z * std + mean`` back to original units (rows or cluster centres)."""
    st = stats if isinstance(stats, dict) else _stats_row(stats)
    out = [(F.col(f"{c}{suffix}") * F.lit(st[f"{c}_std"] or 0.0) + F.lit(st[f"{c}_mean"]))
           .alias(f"{c}{out_suffix}") for c in columns]
    return df.select("*", *out)


def l1_normalize(arr: str | Column) -> Column:
    """Array scaled to unit L1 norm (``Normalizer(p=1)`` on arrays)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    norm = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.abs(v.cast("double")))
    return F.transform(a, lambda v: F.when(norm == 0, F.lit(0.0)).otherwise(v.cast("double") / norm))
