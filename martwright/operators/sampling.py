"""Reproducible splits and oversampling.

``randomSplit`` depends on how the input happens to be partitioned, so a
rerun on a different cluster gives a different split.  Here the random draw
is a hash of ``seed || key``: the same row always lands in the same set, on
any cluster, with no shuffle.

Exact numbers per class need the k rows of smallest hash.  Hashes are uniform, so the
k-th lies close to k/n of their range: rows clearly below or above are decided
where they lie, and only the few between (a multiple of the square root of n) are
ranked.  No whole table is sorted or written for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranking import rank_within


def key_hash(keys: Sequence[str], seed: int | str) -> Column:
    """First 8 hex digits of ``md5(seed || '|' || key1 || '|' || ...)``."""
    parts = [F.lit(str(seed))] + [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)


def _below(h: Column, frac: float) -> Column:
    """The hash lies in the first ``frac`` of its range (all of it for 1)."""
    cut = int(frac * 16 ** 8)
    return F.lit(cut > 0) if cut >= 16 ** 8 or cut <= 0 else h < F.lit(format(cut, "08x"))


def split_hash(df: DataFrame, keys: Sequence[str], train_frac: float = 0.7,
               seed: int | str = 123, name: str = "split") -> DataFrame:
    """Add ``split`` = 'train' / 'test' (a row-local projection)."""
    h = key_hash(keys, seed)
    return df.withColumn(name, F.when(_below(h, train_frac), "train").otherwise("test"))


def smallest_by_hash(df: DataFrame, label: str, keys: Sequence[str], seed: int | str,
                     wanted: Callable[[Column], Column], name: str, plan: DataFrame | None = None,
                     room: float = 8.0) -> DataFrame:
    """Add ``name``: whether the row is among the ``wanted(n)`` rows of its class (of n
    rows) with the smallest hash, ties by the keys.  Rows without a label are a class.
    ``plan``: the class counts ``_l, _n``, if they are known."""
    counts = plan if plan is not None else df.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    whole = float(16 ** 8)
    h = F.conv(key_hash(keys, seed), 16, 10).cast("long")
    while True:
        at, away = F.col("_k") / F.col("_n"), F.lit(room) / F.sqrt("_n") + F.lit(room) / F.col("_n")
        cuts = cut_lineage(counts.withColumn("_k", wanted(F.col("_n")).cast("long")).select(
            "_l", "_k", ((at - away) * whole).alias("_lo"), ((at + away) * whole).alias("_hi")))      # a row a class
        met = df.withColumn("_h", h).join(cuts, F.col(label).eqNullSafe(F.col("_l")))
        state = F.when(F.col("_h") < F.col("_lo"), -1).when(F.col("_h") > F.col("_hi"), 1).otherwise(0)
        met = met.withColumn("_s", state)
        seen = met.groupBy("_l").agg(F.max("_k").alias("_k"), F.count_if(F.col("_s") < 0).alias("_below"), F.count_if(F.col("_s") == 0).alias("_inside"))
        need = cut_lineage(seen.select(F.col("_l").alias("_nl"), (F.col("_k") - F.col("_below")).alias("_need"), "_inside"))
        if room > 1e9 or need.where("_need < 0 or _need > _inside").isEmpty():
            break
        room *= 1e3 if room > 64 else 8      # hashes less even than chance has it (repeated keys): a wider stretch is ranked
    own = [F.col(f"`{c}`") for c in df.columns]
    clear = met.where("_s != 0").select(*own, (F.col("_s") < 0).alias(name))
    near = rank_within(met.where("_s = 0").select(*own, "_h"), label, [("_h", False)] + [(k, False) for k in keys], "_r")
    ranked = near.join(need, F.col(label).eqNullSafe(F.col("_nl"))).select(*own, (F.col("_r") <= F.col("_need")).alias(name))
    return clear.unionByName(ranked)


def split_stratified(df: DataFrame, label: str, keys: Sequence[str], train_frac: float = 0.7,
                     seed: int | str = 123, name: str = "split") -> DataFrame:
    """Exactly ``round(train_frac * n_class)`` rows of each class go to
    train: those of smallest key hash within their class.  Rows without a label are a class."""
    tenths = int(round(train_frac * 10))

    def cut(n: Column) -> Column:
        if abs(train_frac * 10 - tenths) > 1e-9:
            return F.round(n * train_frac).cast("long")
        return F.floor((n * tenths + 5) / 10).cast("long")       # exact integer rounding for x/10 fractions
    tagged = smallest_by_hash(df, label, keys, seed, cut, "_in")
    return tagged.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_in"), "train").otherwise("test").alias(name))


def oversample(df: DataFrame, label: str, keys: Sequence[str], seed: int | str = 123,
               chunk: int = 1000) -> DataFrame:
    """Random oversampling of every class to the majority class size; rows
    without a label are a class.

    A class of ``n`` rows (majority ``m``) is copied ``m // n`` times with
    ``explode(sequence)`` and the ``m % n`` rows with the smallest key hash
    are copied once more.  The class-count table has one row per class.

    The copies are generated in two steps, blocks of ``chunk`` first, spread
    over tasks by ``(keys, block)``, then the copies inside each block, so
    that no task produces all copies of a tiny class next to a huge one.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    m = counts.agg(F.max("_n")).first()[0]
    if m is None:  # no rows: nothing to copy
        return df.withColumn("copy", F.lit(1).cast("long"))
    classes = cut_lineage(counts.select(F.col(label).alias("_l"), "_n"))
    x = smallest_by_hash(df, label, keys, seed, lambda n: F.lit(m) % n, "_more", classes)
    j = x.join(classes, F.col(label).eqNullSafe(F.col("_l")))  # one row per class; AQE picks the join strategy
    j = j.withColumn("_c", (F.floor(F.lit(m) / F.col("_n")) + F.col("_more").cast("int")).cast("long"))
    blocks = j.withColumn("_b", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_c") - 1) / chunk).cast("long"))))
    blocks = blocks.repartition(*[F.col(k) for k in keys], F.col("_b"))
    first = F.col("_b") * chunk + 1
    last = F.least(F.col("_c"), (F.col("_b") + 1) * chunk)
    out = blocks.withColumn("copy", F.explode(F.sequence(first, last)))
    return out.drop("_n", "_more", "_c", "_b", "_l")
