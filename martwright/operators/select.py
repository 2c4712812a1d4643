"""Exact order statistics of columns, whole or per group, without sorting them.

Three passes whatever the data, the number of groups or the values in them:

1. one partial aggregate: every column's count, smallest and largest value,
   and from one ``percentile_approx`` sketch a bracket around every wanted
   position, a few error widths wide;
2. one partial aggregate: how many values lie below each bracket;
3. the values inside the brackets (a few thousandths of the rows), counted
   per distinct value by a partial aggregate; a distributed prefix sum over
   these counts then meets every wanted rank.

A value shared by a third of all rows is one counted row; infinities are
values like any other; nulls and NaN are left out.  64-bit integers and wide
decimals are compared as such, not as doubles.  No values are gathered in a
task or on the driver; the whole-column forms return one number per rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, LongType

from ..session import cut_lineage
from .ranking import prefix_sums

#: accuracy of the sketch the brackets come from; a column of no more rows has its whole range as bracket
ACCURACY = 10_000


def _values(df: DataFrame, c: str) -> tuple[Column, Column]:
    """(the column without NaN, its exact form or null) of a numeric column."""
    kind = df.schema[c].dataType
    x = F.col(f"`{c}`")
    if isinstance(kind, (DoubleType, FloatType)):
        x = F.when(~F.isnan(x), x)
    wide = isinstance(kind, LongType) or isinstance(kind, DecimalType) and kind.precision > 15
    return x, x.try_cast("decimal(38,18)") if wide else F.lit(None).cast("decimal(38,18)")


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict:
    """``{column: (n, min, max)}`` over non-null, non-NaN values (one pass)."""
    out = []
    for i, c in enumerate(columns):
        x = _values(df, c)[0].cast("double")
        out += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    row = df.agg(*out).first()
    return {c: (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)}


def ranked_values(df: DataFrame, wanted: Mapping[str, Sequence[tuple]], group: str | None = None,
                  margin: float | None = None) -> DataFrame:
    """``[group,] column, name, value`` (double): the value at the rank of every
    wanted position.  ``wanted[column]`` lists ``(name, share, rank)``: about
    what share of the values lies below, and the 1-based rank as a function of
    the count column.  Columns or groups without values have no rows."""
    margin = 2 / ACCURACY if margin is None else margin
    columns = list(wanted)
    vals = {c: _values(df, c) for c in columns}
    g = F.col(f"`{group}`") if group else F.lit(0)
    base = df.select(g.alias("_g"), *[x for i, c in enumerate(columns) for x in (
        vals[c][0].alias(f"x{i}"), vals[c][1].alias(f"e{i}"))])
    shares = {c: sorted({s for _, s, _ in w}) for c, w in wanted.items()}

    sketches = []
    for i, c in enumerate(columns):
        at = [min(1.0, max(0.0, s + d)) for s in shares[c] for d in (-margin, margin)]
        x = F.col(f"x{i}")
        sketches += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"),
                     F.percentile_approx(x, at, ACCURACY).alias(f"q{i}")]
    ends = []
    for i, c in enumerate(columns):
        few = F.col(f"n{i}") <= ACCURACY
        ends.append(F.col(f"n{i}"))
        for k, s in enumerate(shares[c]):
            ends += [F.when(few | F.lit(s <= margin), F.col(f"a{i}")).otherwise(F.col(f"q{i}")[2 * k]).alias(f"lo{i}_{k}"),
                     F.when(few | F.lit(s >= 1 - margin), F.col(f"z{i}")).otherwise(F.col(f"q{i}")[2 * k + 1]).alias(f"hi{i}_{k}")]
    brackets = cut_lineage(base.groupBy("_g").agg(*sketches).select(F.col("_g").alias("_b"), *ends))
    slots = [(i, k) for i, c in enumerate(columns) for k in range(len(shares[c]))]

    if group:
        met = base.join(brackets, F.col("_g").eqNullSafe(F.col("_b")))
    else:                                           # one row of brackets: literals
        row = brackets.first()
        kinds = {f.name: f.dataType for f in brackets.schema.fields}
        met = base.select("*", *[F.lit(row[n] if row else None).cast(kinds[n]).alias(n) for n in brackets.columns if n != "_b"])
    below = met.groupBy("_g").agg(*[F.count_if(F.col(f"x{i}") < F.col(f"lo{i}_{k}")).alias(f"u{i}_{k}") for i, k in slots])
    entries = [F.when((F.col(f"x{i}") >= F.col(f"lo{i}_{k}")) & (F.col(f"x{i}") <= F.col(f"hi{i}_{k}")),
                      F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.col(f"x{i}").cast("double").alias("d"),
                               F.col(f"e{i}").alias("e"))) for i, k in slots]
    inside = (met.select("_g", F.explode(F.filter(F.array(*entries), lambda s: s.isNotNull())).alias("s"))
              .groupBy("_g", "s.i", "s.k", "s.d", "s.e").agg(F.count(F.lit(1)).alias("n")))
    order = [(c, False) for c in ("_g", "i", "k", "d", "e")]
    run = cut_lineage(prefix_sums(inside, order, ["n"]))
    start = run.groupBy(F.col("_g").alias("_s"), F.col("i").alias("si"), F.col("k").alias("sk")).agg(
        F.min(F.col("cum_n") - F.col("n")).alias("_start"))

    known = below.withColumnRenamed("_g", "_t").join(brackets, F.col("_t").eqNullSafe(F.col("_b")))
    goals = []
    for i, c in enumerate(columns):
        for name, s, rank in wanted[c]:
            k = shares[c].index(s)
            goals.append(F.when(F.col(f"n{i}") > 0, F.struct(
                F.lit(i).alias("ti"), F.lit(k).alias("tk"), F.lit(str(name)).alias("name"),
                (rank(F.col(f"n{i}")) - F.col(f"u{i}_{k}")).cast("long").alias("need"))))
    goals = cut_lineage(known.select("_t", F.explode(F.filter(F.array(*goals), lambda s: s.isNotNull())).alias("t")).select("_t", "t.*"))
    key = F.col("_g").eqNullSafe(F.col("_t")) & (F.col("i") == F.col("ti")) & (F.col("k") == F.col("tk"))
    here = F.col("cum_n") - F.col("_start")
    spots = goals.join(start, F.col("_t").eqNullSafe(F.col("_s")) & (F.col("ti") == F.col("si")) & (F.col("tk") == F.col("sk")))
    found = cut_lineage(run.join(spots, key).where((here >= F.col("need")) & (here - F.col("n") < F.col("need")))
                        .select("_t", "ti", "name", F.coalesce(F.col("e").cast("double"), F.col("d")).alias("value")))
    if margin < 1 and found.count() < goals.count():
        # a sketch was further off than it promises: wider brackets
        return ranked_values(df, wanted, group, margin=min(1.0, margin * 50))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("ti") + 1)
    return found.select(*([F.col("_t").alias(group)] if group else []), names.alias("column"), "name", "value")


def select_ranks(df: DataFrame, targets: Mapping[str, Sequence[int]], stats: Mapping[str, tuple] | None = None) -> dict:
    """``{(column, rank): value}`` for every requested 1-based rank."""
    stats = dict(stats or column_stats(df, list(targets)))
    wanted = {}
    for c, ranks in targets.items():
        n = stats[c][0]
        for r in set(ranks):
            if not n or r < 1 or r > n:
                raise ValueError(f"rank {r} outside 1..{n} for {c!r}")
        wanted[c] = [(r, (r - 0.5) / n, lambda _, r=r: F.lit(r)) for r in sorted(set(ranks))]
    return {(r.column, int(r.name)): r.value for r in ranked_values(df, wanted).collect()}


def quantile_ends(probs: Sequence[float]) -> list[tuple]:
    """The ranks around ``(n - 1) * p`` as positions for :func:`ranked_values`."""
    out = []
    for p in probs:
        pos = lambda n, p=p: (n - 1) * F.lit(float(p))
        out += [(f"lo{p}", p, lambda n, pos=pos: F.floor(pos(n)) + 1), (f"hi{p}", p, lambda n, pos=pos: F.ceil(pos(n)) + 1)]
    return out


def interpolated_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict:
    """``{(column, p): value}``: SQL ``percentile`` (linear interpolation
    between the order statistics around ``(n - 1) * p``), exact; None for a
    column without values."""
    stats = column_stats(df, columns)
    rows = ranked_values(df, {c: quantile_ends(probs) for c in columns}).collect() if columns else []
    at = {(r.column, r.name): r.value for r in rows}
    out = {}
    for c in columns:
        for p in probs:
            if (c, f"lo{p}") not in at:
                out[(c, p)] = None
                continue
            pos = (stats[c][0] - 1) * p
            lo, hi = math.floor(pos), math.ceil(pos)
            lv, hv = at[(c, f"lo{p}")], at[(c, f"hi{p}")]
            out[(c, p)] = lv if hi == lo or lv == hv else (hi - pos) * lv + (pos - lo) * hv
    return out


def grouped_quantiles(df: DataFrame, group: str, columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """``group, column, <name>...``: :func:`interpolated_quantiles` per group, one column per name in ``probs``."""
    ends = ranked_values(df, {c: quantile_ends(list(probs.values())) for c in columns}, group)
    counts = df.groupBy(F.col(f"`{group}`").alias("_c")).agg(*[F.count(_values(df, c)[0]).alias(f"n{i}") for i, c in enumerate(columns)])
    n = F.element_at(F.array(*[F.col(f"n{i}") for i in range(len(columns))]),
                     F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int"))
    wide = ends.groupBy(group, "column").agg(*[F.max(F.when(F.col("name") == f"{e}{p}", F.col("value"))).alias(f"{e}_{m}")
                                              for m, p in probs.items() for e in ("lo", "hi")])
    met = wide.join(counts, wide[group].eqNullSafe(F.col("_c")))
    cols = []
    for m, p in probs.items():
        pos = (n - 1) * F.lit(float(p))
        lo, hi, lv, hv = F.floor(pos), F.ceil(pos), F.col(f"lo_{m}"), F.col(f"hi_{m}")
        cols.append(F.when((hi == lo) | (lv == hv), lv).otherwise((hi - pos) * lv + (pos - lo) * hv).alias(m))
    return met.select(group, "column", *cols)
