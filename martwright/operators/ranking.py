"""Distributed running sums and ranks (no single-partition global window).

A global ``Window.orderBy`` without ``partitionBy`` moves every row into
one task.  ``prefix_sums`` instead range-partitions on the full order key
(Spark samples the key to pick balanced bounds, so even a value shared by a
third of the rows is split by the tie-break columns), takes running sums
inside each range with a window partitioned by range id, and adds the
totals of all earlier ranges.  The per-range totals table has one row per
range, so it is bounded by the partition count and can be broadcast.
``global_rank`` needs no window at all: positions inside the sorted, pinned
ranges plus per-range row counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _order_cols(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in order]


def prefix_sums(df: DataFrame, order: Sequence[tuple[str, bool]], values: Sequence[str],
                inclusive: bool = True, n_ranges: int | None = None, pin: bool = True,
                prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<v>`` = sum of ``v`` over all rows up to this one in
    ``order`` (a list of ``(column, descending)``; make it a total order by
    ending with a unique column).  ``inclusive=False`` excludes the row.

    ``n_ranges`` fixes the number of ranges; by default Spark's shuffle
    partition count is used and AQE coalesces neighbouring ranges (which
    keeps them ordered).  The range-partitioned rows are pinned with a
    reliable checkpoint in the shared folder, so the running sums and the
    per-range totals read the
    SAME range assignment.  (Two unpinned branches would each sample their
    own range bounds and disagree: measured, AUC drifted run to run.)
    ``pin=False`` is honoured only for a single range, where the assignment
    is trivially the same.
    """
    oc = _order_cols(order)
    if n_ranges:
        r = df.repartitionByRange(n_ranges, *oc)
    else:
        # no fixed count: AQE coalesces neighbouring ranges to the advisory
        # partition size, so small inputs get few ranges and big ones many
        r = df.repartitionByRange(*oc)
    r = r.withColumn("_rid", F.spark_partition_id())
    if pin or n_ranges != 1:
        r = cut_lineage(r)
    frame = (Window.partitionBy("_rid").orderBy(*oc)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    local = r.select("*", *[F.coalesce(F.sum(v).over(frame), F.lit(0)).alias(f"_loc_{v}") for v in values])
    totals = r.groupBy("_rid").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # one row per range: the ordered window over it is bounded by the range count
    before = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_rid", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0))
                                      .alias(f"_off_{v}") for v in values])
    out = local.join(F.broadcast(offsets), "_rid")
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(f"_loc_{v}") + F.col(f"_off_{v}")).alias(f"{prefix}{v}") for v in values])


def global_rank(df: DataFrame, order: Sequence[tuple[str, bool]], name: str = "rank",
                n_ranges: int | None = None, **kw) -> DataFrame:
    """1-based position in ``order`` (``row_number`` without one task).

    Rows are range-partitioned on the full order key and pinned; inside each
    range they are sorted and numbered by their position in the partition
    (``monotonically_increasing_id`` keeps the position in its low 33 bits),
    so no window and no second shuffle of the rows is needed; per-range row
    counts (one row per range) give the offsets.  ``order`` must be a total
    order (end it with a unique column).
    """
    oc = _order_cols(order)
    r = df.repartitionByRange(n_ranges, *oc) if n_ranges else df.repartitionByRange(*oc)
    r = cut_lineage(r.withColumn("_rid", F.spark_partition_id()))
    local = r.sortWithinPartitions(*oc).withColumn(
        "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    counts = r.groupBy("_rid").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_rid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    out = local.join(F.broadcast(offsets), "_rid")  # one row per range
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      (F.col("_pos") + F.col("_off") + 1).alias(name))


def rank_within(df: DataFrame, group: str, order: Sequence[tuple[str, bool]],
                name: str = "rank", **kw) -> DataFrame:
    """1-based position inside each ``group`` by ``order`` (``row_number``
    over ``partitionBy(group)``), distributed even when one group holds most
    rows: a global rank over ``(group, order)`` minus the group's start,
    which comes from a per-group count (one row per group)."""
    g = global_rank(df, [(group, False), *order], "_grank", **kw)
    starts = g.groupBy(F.col(group).alias("_group")).agg(F.min("_grank").alias("_start"))
    return g.join(starts, F.col(group).eqNullSafe(F.col("_group"))).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_grank") - F.col("_start") + 1).alias(name))


def ntile_from_rank(rank: Column | str, n: Column | str, buckets: int) -> Column:
    """SQL ``NTILE(buckets)`` from a 1-based rank and the row count: the
    first ``n % buckets`` tiles hold one extra row."""
    r = F.col(rank) if isinstance(rank, str) else rank
    n = F.col(n) if isinstance(n, str) else n
    q = F.floor(n / buckets)
    rem = n - q * buckets
    big = rem * (q + 1)
    return F.when(r <= big, F.floor((r - 1) / (q + 1)) + 1) \
        .otherwise(rem + F.floor((r - 1 - big) / q) + 1).cast("int")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float],
                    group: str | None = None, **kw) -> DataFrame:
    """Exact interpolated quantiles (the rule of SQL ``percentile`` /
    ``quantile_cont``) per ``group``, without gathering a group in one task.

    Rows get one global rank over ``(group, value, row id)`` (range
    partitioning, so a group or a value holding a third of the rows is still
    spread over many ranges).  Each group's first global rank comes from a
    prefix sum over the per-group counts (one row per group), so the two
    ranks around each position ``(n - 1) * p`` are known as global ranks and
    picked with one equi-join on the rank; then interpolated.
    Output: ``[group,] p, quantile``.
    """
    g = group or "_g"
    x = df.select((F.col(group) if group else F.lit(0)).alias(g),
                  F.col(value).cast("double").alias("_v"))
    x = x.where(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_id", F.monotonically_increasing_id())
    ranked = global_rank(x, [(g, False), ("_v", False), ("_id", False)], "_r", **kw)
    counts = x.groupBy(g).agg(F.count(F.lit(1)).alias("_n"))
    starts = prefix_sums(counts, [(g, False)], ["_n"], inclusive=False, prefix="_before", **kw)
    ps = F.array(*[F.lit(float(p)) for p in probs])
    pos = starts.select(g, "_before_n", "_n", F.explode(ps).alias("p")).select(
        g, "p", "_before_n", ((F.col("_n") - 1) * F.col("p")).alias("_pos"))
    ends = pos.select(g, "p", "_pos", F.explode(F.array(
        F.struct(F.lit("lo").alias("role"), (F.col("_before_n") + F.floor("_pos") + 1).cast("long").alias("_r")),
        F.struct(F.lit("hi").alias("role"), (F.col("_before_n") + F.ceil("_pos") + 1).cast("long").alias("_r"))
    )).alias("e")).select(g, "p", "_pos", "e.role", "e._r")
    picked = ranked.select("_r", "_v").join(ends, "_r")
    q = picked.groupBy(g, "p").agg(F.first("_pos").alias("_pos"),
                                   F.max(F.when(F.col("role") == "lo", F.col("_v"))).alias("_lv"),
                                   F.max(F.when(F.col("role") == "hi", F.col("_v"))).alias("_hv"))
    lo = F.floor("_pos")
    hi = F.ceil("_pos")
    val = F.when(hi == lo, F.col("_lv")).when(F.col("_lv") == F.col("_hv"), F.col("_lv")) \
        .otherwise((hi - F.col("_pos")) * F.col("_lv") + (F.col("_pos") - lo) * F.col("_hv"))
    return q.select(*([g] if group else []), "p", val.alias("quantile"))
