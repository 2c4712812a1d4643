"""Per-entity aggregation, pivots, trailing windows and calendar features.

Design rules (they are what keeps these operators cheap at scale):

* Every operator is ONE ``groupBy(key).agg(...)``: Spark does a map-side
  partial aggregation, so a hot key holding a third of all rows still ships
  only one partial row per map task, never its raw rows.
* Pivots are conditional aggregates over an explicit, sorted value list.
  That is one shuffle (Spark's ``pivot`` is two) and the output schema does
  not depend on data order.  Value discovery, when no list is given, is a
  ``distinct`` whose size is capped by ``max_values``.
* Several windows / calendars over one table are folded into the same
  aggregate instead of one scan and one join per window.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# aggregate vocabulary
# ---------------------------------------------------------------------------

_FUNCS = ("count", "count_rows", "sum", "mean", "min", "max")


def agg_expr(fn: str, c: Column | str | None) -> Column:
    """One named aggregate.  ``mean`` is ``sum / count`` in double, which is
    what ``avg`` does for doubles and stays exact for decimal inputs."""
    if fn == "count_rows":
        return F.count(F.lit(1))
    col = F.col(c) if isinstance(c, str) else c
    if fn == "count":
        return F.count(col)
    if fn == "sum":
        return F.sum(col)
    if fn == "mean":
        return F.try_divide(F.sum(col).cast("double"), F.count(col).cast("double"))
    if fn == "min":
        return F.min(col)
    if fn == "max":
        return F.max(col)
    raise ValueError(f"unknown aggregate {fn!r}; expected one of {_FUNCS}")


def safe_name(v) -> str:
    """Column-name-safe rendering of a category value."""
    if v is None:
        return "null"
    s = re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_")
    return s or "blank"


def safe_names(values: Sequence) -> dict:
    """``{value: name}``; values that ``safe_name`` renders alike (``A+`` and
    ``A-``) get a number from the second on, in the order given."""
    out, taken = {}, set()
    for v in values:
        base = name = safe_name(v)
        k = 2
        while name.lower() in taken:
            name, k = f"{base}_{k}", k + 1
        taken.add(name.lower())
        out[v] = name
    return out


def entity_aggregates(df: DataFrame, keys: str | Sequence[str],
                      spec: Mapping[str, Sequence[str]],
                      names: Mapping[tuple[str, str], str] | None = None,
                      drop_null_keys: bool = True) -> DataFrame:
    """``groupBy(keys)`` with ``spec = {column: [fn, ...]}``.

    Output columns are ``<fn>_<column>`` unless renamed through ``names``
    (keyed by ``(fn, column)``).  Null keys are dropped by default, as the
    reference's grouping did.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = dict(names or {})
    exprs = []
    for c, fns in spec.items():
        for fn in fns:
            exprs.append(agg_expr(fn, c).alias(names.get((fn, c), f"{fn}_{c}")))
    if drop_null_keys:
        df = df.where(_all_not_null(keys))
    return df.groupBy(*keys).agg(*exprs)


def _all_not_null(cols: Sequence[str]) -> Column:
    cond = F.col(cols[0]).isNotNull()
    for c in cols[1:]:
        cond = cond & F.col(c).isNotNull()
    return cond


# ---------------------------------------------------------------------------
# pivots
# ---------------------------------------------------------------------------

def discover_values(df: DataFrame, c: str, include_null: bool = False) -> list:
    """Sorted distinct values of ``c``, for columns known to be categories:
    each becomes output columns, so the plan holds them all anyway.  Pivots
    never call this by themselves; for a column of unknown width use the long
    format (``groupBy(key, column)``) instead.
    """
    q = df.select(c).distinct()
    if not include_null:
        q = q.where(F.col(c).isNotNull())
    vals = [r[0] for r in q.collect()]
    return sorted(vals, key=lambda v: (v is not None, v)) if include_null else sorted(vals)


def pivot_aggs(pivot_col: str, values: Sequence, aggs: Sequence[tuple[str, str | None, str]],
               name_fmt: str = "{alias}_{value}") -> list[Column]:
    """Conditional aggregates, one per (value, agg).

    ``aggs`` holds ``(fn, column, alias)``.  Rows whose pivot value is not in
    ``values`` do not contribute.  A null entry in ``values`` selects rows
    with a null pivot value.
    """
    p = F.col(pivot_col)
    out = []
    named = safe_names(values)
    for v in values:
        cond = p.isNull() if v is None else (p == F.lit(v))
        for fn, c, alias in aggs:
            if fn == "count_rows":
                e = F.count(F.when(cond, F.lit(1)))
            else:
                col = F.col(c) if isinstance(c, str) else c
                e = agg_expr(fn, F.when(cond, col))
            out.append(e.alias(name_fmt.format(alias=alias, value=named[v])))
    return out


def pivot_agg(df: DataFrame, keys: str | Sequence[str], pivot_col: str,
              aggs: Sequence[tuple[str, str | None, str]], values: Sequence,
              null_category: str = "drop",
              name_fmt: str = "{alias}_{value}") -> DataFrame:
    """``groupBy(keys).pivot(pivot_col)`` with several aggregates, one shuffle.

    ``null_category``: ``'drop'`` ignores rows with a null pivot value (the
    intent of the reference's ``drop("null")``), ``'keep'`` adds a ``null``
    column.  A category absent for an entity gives null for sums/means and
    0 for counts; the mart fill turns both into 0.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = list(values)
    if null_category == "keep" and None not in values:
        values.append(None)
    elif null_category == "drop":
        values = [v for v in values if v is not None]
    if not values:  # nothing to pivot (e.g. no data): the keys alone
        return df.groupBy(*keys).count().drop("count")
    return df.groupBy(*keys).agg(*pivot_aggs(pivot_col, values, aggs, name_fmt))


def group_mean(value_col: str = "_m") -> Column:
    """The mean of a group as a fixed-point number (8 digits): sums of such
    means are exact, so they do not depend on the order in which partial rows
    arrive."""
    return F.col(value_col).cast("decimal(28,8)")


def pivot_mean_of_groups(df: DataFrame, key: str, pivot_col: str, inner_col: str,
                         value_col: str, values: Sequence, combine: str = "mean") -> DataFrame:
    """Aggregate on ``(key, pivot, inner)`` first, then pivot on ``pivot``.

    Step 1 computes count, sum and mean of ``value_col`` per
    ``(key, pivot_col, inner_col)``.  Step 2 combines those group values per
    ``(key, pivot_col)`` with ``combine`` ('mean' is pandas' ``pivot_table``
    default, i.e. the unweighted mean over the inner groups; 'sum' gives the
    plain totals for count and sum).  Output: ``count_<v>``, ``sum_<v>``,
    ``mean_<v>`` per pivot value.

    Both steps are partial aggregates; the second runs on already reduced
    rows.  Hashing step 1 on all three keys also spreads a hot entity over
    many tasks.  Group means are added as fixed-point numbers
    (``group_mean``), whatever the number of inner groups.
    """
    g = (df.where(F.col(key).isNotNull() & F.col(pivot_col).isNotNull())
         .groupBy(key, pivot_col, inner_col)
         .agg(F.count(value_col).alias("_n"), F.sum(value_col).alias("_s"),
              agg_expr("mean", value_col).alias("_m"))
         .withColumn("_m", group_mean()))
    fn = "mean" if combine == "mean" else "sum"
    return g.groupBy(key).agg(*pivot_aggs(
        pivot_col, values, [(fn, "_n", "count"), (fn, "_s", "sum"), ("mean", "_m", "mean")]))


# ---------------------------------------------------------------------------
# date windows, calendar pivots, recency
# ---------------------------------------------------------------------------

def _date(v) -> Column:
    return F.to_date(F.lit(v)) if isinstance(v, str) else v


def window_sum_aggs(date_col: str, amount_col: str, cutoff: str,
                    windows: Mapping[str, str]) -> list[Column]:
    """Sum of ``amount`` with ``lower < date < cutoff`` for each named window.

    Both ends are open.  ``windows`` maps output name -> lower bound (date
    string).  Entities without a row in a window get null (filled later).
    """
    d = F.col(date_col)
    hi = _date(cutoff)
    return [F.sum(F.when((d > _date(lo)) & (d < hi), F.col(amount_col))).alias(name)
            for name, lo in windows.items()]


def years_before(cutoff: str, years: Iterable[int], prefix: str = "amt_") -> dict:
    """``{f'{prefix}{n}y': cutoff - n years}`` lower bounds for ``window_sum_aggs``."""
    import datetime as _dt
    c = _dt.date.fromisoformat(cutoff)
    out = {}
    for n in years:
        try:
            lo = c.replace(year=c.year - n)
        except ValueError:  # 29 Feb
            lo = c.replace(year=c.year - n, day=28)
        out[f"{prefix}{n}y"] = lo.isoformat()
    return out


def trailing_window_sums(df: DataFrame, key: str, date_col: str, amount_col: str,
                         cutoff: str, windows: Mapping[str, str],
                         base_window: str | None = None) -> DataFrame:
    """All trailing windows in one pass; keep entities of ``base_window``.

    The reference builds each window with its own filter + groupBy and then
    left-joins them onto the widest one.  Here the widest window bounds the
    scan filter (pushed to parquet as a range on the date column), all sums
    are computed by one aggregate, and entities without any row in the base
    window are dropped, as the join chain did.
    """
    widest = min(windows.values())
    base_window = base_window or min(windows, key=lambda k: windows[k])
    d = F.col(date_col)
    scoped = df.where(F.col(key).isNotNull() & (d > _date(widest)) & (d < _date(cutoff)))
    out = scoped.groupBy(key).agg(*window_sum_aggs(date_col, amount_col, cutoff, windows))
    return out.where(F.col(base_window).isNotNull())


def calendar_aggs(date_col: str, amount_col: str, years: Sequence[int],
                  months: Sequence[int] = tuple(range(1, 13))) -> list[Column]:
    """Per-year and per-month sums of ``amount`` (``year_<y>``, ``month_<m>``)."""
    d = F.col(date_col)
    a = F.col(amount_col)
    return ([F.sum(F.when(F.year(d) == y, a)).alias(f"year_{y}") for y in years] +
            [F.sum(F.when(F.month(d) == m, a)).alias(f"month_{m}") for m in months])


CALENDAR_QUARTERS = {"Q1": (1, 2, 3), "Q2": (4, 5, 6), "Q3": (7, 8, 9), "Q4": (10, 11, 12)}


def calendar_post(years: Sequence[int], quarters: Mapping[str, Sequence[int]] | None = None,
                  keep_months: bool = True, keep_years: bool = False) -> list[Column]:
    """Projection after ``calendar_aggs``: fill 0, active-year count, quarters."""
    quarters = CALENDAR_QUARTERS if quarters is None else quarters
    z = lambda n: F.coalesce(F.col(n), F.lit(0))
    cols = []
    if keep_years:
        cols += [z(f"year_{y}").alias(f"year_{y}") for y in years]
    if keep_months:
        cols += [z(f"month_{m}").alias(f"month_{m}") for m in range(1, 13)]
    active = [(z(f"year_{y}") > 0).cast("int") for y in years]
    cols.append((sum(active[1:], active[0]) if active else F.lit(0)).alias("frequency_gifts"))
    for q, ms in quarters.items():
        parts = [z(f"month_{m}") for m in ms]
        cols.append(sum(parts[1:], parts[0]).alias(q))
    return cols


def pivot_calendar(df: DataFrame, key: str, date_col: str, amount_col: str,
                   years: Sequence[int] | None = None, cutoff: str | None = None,
                   quarters: Mapping[str, Sequence[int]] | None = None,
                   keep_months: bool = True) -> DataFrame:
    """Year and month pivots of the amount, active years, quarter sums.

    ``cutoff`` keeps only rows strictly before it (the reference used all
    rows, leaking the label period into the features).
    """
    if cutoff is not None:
        df = df.where(F.col(date_col) < _date(cutoff))
    df = df.where(F.col(key).isNotNull())
    if years is None:
        years = discover_values(df.select(F.year(date_col).alias("_y")), "_y")
    g = df.groupBy(key).agg(*calendar_aggs(date_col, amount_col, years))
    return g.select(key, *calendar_post(years, quarters, keep_months))


def recency_aggs(date_col: str, cutoff: str | None = None, prefix: str = "") -> list[Column]:
    """First and last date (last strictly before ``cutoff`` when given)."""
    d = F.col(date_col)
    last = F.max(F.when(d < _date(cutoff), d)) if cutoff else F.max(d)
    first = F.min(F.when(d < _date(cutoff), d)) if cutoff else F.min(d)
    return [F.to_date(first).alias(f"{prefix}first_date"),
            F.to_date(last).alias(f"{prefix}last_date")]


def recency_post(eval_date: str, prefix: str = "") -> list[Column]:
    """Days since last, lifetime first->last, as whole days."""
    first, last = F.col(f"{prefix}first_date"), F.col(f"{prefix}last_date")
    return [F.datediff(_date(eval_date), last).alias(f"{prefix}recency_days"),
            F.datediff(last, first).alias(f"{prefix}lifetime_days")]


def recency_lifetime(df: DataFrame, key: str, date_col: str, eval_date: str,
                     cutoff: str | None = None) -> DataFrame:
    """Per entity: first date, last date (< cutoff), days since last at
    ``eval_date``, and lifetime in days."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(*recency_aggs(date_col, cutoff))
    if cutoff:
        g = g.where(F.col("last_date").isNotNull())
    return g.select("*", *recency_post(eval_date))


def churn_label(df: DataFrame, key: str, end_col: str, start_col: str,
                as_of: str, threshold_days: int = 180) -> DataFrame:
    """Days without subscription at ``as_of`` and the label ``> threshold``."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.to_date(F.max(end_col)).alias("last_end"),
        F.to_date(F.min(start_col)).alias("first_start"))
    days = F.datediff(_date(as_of), F.col("last_end"))
    return g.select(key, "last_end", "first_start",
                    days.alias("days_without"),
                    F.datediff("last_end", "first_start").alias("customer_lifetime"),
                    F.when(days > threshold_days, 1).otherwise(0).alias("label"))
