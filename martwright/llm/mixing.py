"""Mixing sources to target weights by Poisson replication.

A source with target share w among ``total`` documents gets the mean repetition
rate ``lambda = w * total / (documents of the source)``.  Each document draws
its number of copies by inverting the Poisson distribution at a point in [0, 1)
that is a hash of seed and id: the draw needs no state, is the same on every
run and partitioning, and an executor that is lost redraws the same numbers.
Copies are dealt to all partitions by a second hash and sorted on it there, a
global shuffle that keeps no trace of the source order.

The expected share of a source is exactly its weight.  All work is DataFrame
functions; the only group sizes are two partial counts.

Defined results: a null source is a source of its own (weight key ``None``);
sources without a weight, or of weight zero, get no copies; null ids draw as
the text ``null``; rows that repeat an id draw the same count; an empty table
gives an empty result; other columns are carried whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

#: hexadecimal digits of the hash that make the uniform point (52 bits: exact in a double)
DIGITS = 13
#: mean copies of a rate's part, inverted by one table (exp(-rate) must not underflow)
PART = 512
#: least probability that a table tells apart
LEAST = 1e-17
#: copies that a task makes of a row at a time
COPIES = 1_024


def uniform(seed: str, *keys: Column) -> Column:
    """Point in [0, 1) from the MD5 of the seed and the keys."""
    said = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(said), 1, DIGITS), 16, 10).cast("long").cast("double") / F.lit(float(16 ** DIGITS))


def cumulative(rate: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... copies, to where the tail is
    under a point's resolution: one array for each source."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(s, i):
        p = s["p"] * rate / i
        more = F.concat(s["c"], F.array(F.element_at(s["c"], -1) + p))
        return F.struct(p.alias("p"), F.when((p > LEAST) | (i <= rate), more).otherwise(s["c"]).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), zero, step, lambda s: s["c"])


def poisson_count(table: Column, parts: Column, point: Column) -> Column:
    """Number of probabilities at or below the point, summed over the equal parts of
    a rate, each with a point of its own (a sum of Poisson variables is Poisson;
    the first, and in all usual cases only, part uses the point itself)."""
    def invert(u: Column) -> Column:
        return F.size(F.filter(table, lambda c: c <= u)).cast("long")
    many = F.aggregate(F.sequence(F.lit(1).cast("long"), parts), F.lit(0).cast("long"),
                       lambda n, i: n + invert(F.when(i == 1, point).otherwise(uniform("part", point, i))))
    return F.when(parts == 1, invert(point)).otherwise(many)


def source_rates(df: DataFrame, source_col: str, weights: Mapping | None, total: float | None = None) -> DataFrame:
    """``_source, _docs, _weight, _rate``: one row per source that gets copies.

    ``weights`` None gives every source the same share.  Weights are taken
    relative to their sum over the sources that have documents; ``total`` is
    the expected size of the mix (default: as many documents as there are).
    Weights that are negative, infinite or no numbers are an error."""
    if weights is not None and not all(w is not None and math.isfinite(w) and w >= 0 for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    counts = df.groupBy(F.col(source_col).alias("_source")).agg(F.count(F.lit(1)).alias("_docs"))
    if weights is None:
        weighed = counts.withColumn("_weight", F.lit(1.0))
    else:
        spark = df.sparkSession
        given = spark.createDataFrame([(None if k is None else str(k), float(w)) for k, w in weights.items()] or
                                      [(None, 0.0)], "_name string, _weight double")
        weighed = counts.join(given, F.col("_source").cast("string").eqNullSafe(F.col("_name"))).drop("_name")
    weighed = pin(weighed.filter("_weight > 0"))
    sums = weighed.agg(F.sum("_weight").alias("w")).first()
    size = counts.agg(F.sum("_docs").alias("n")).first()
    if not sums.w:
        return weighed.withColumn("_rate", F.lit(0.0)).limit(0)
    aim = float(total if total is not None else size.n)
    return weighed.withColumn("_rate", F.col("_weight") / sums.w * aim / F.col("_docs"))


def mix_sources(df: DataFrame, weights: Mapping | None = None, id_col: str = "doc_id",
                source_col: str = "source", total: float | None = None, seed: str = "mix",
                numbered: bool = True) -> DataFrame:
    """Every column of ``df``, each row repeated by its Poisson count, globally
    shuffled; if ``numbered``, with ``_copy`` (from 1), ``_rate`` and ``_order``
    (the shuffle key)."""
    parts = F.greatest(F.ceil(F.col("_rate") / PART), F.lit(1)).cast("long")
    # pinned: the planner knows its size, broadcasts it below its threshold and joins it by source above
    rates = pin(source_rates(df, source_col, weights, total).filter("_rate > 0").select(
        "_source", "_rate", parts.alias("_parts"), cumulative(F.col("_rate") / parts).alias("_table")))
    cols = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_r"),
                       F.col(id_col).alias("_id"), F.col(source_col).alias("_s"))

    def drawn(of: DataFrame) -> DataFrame:
        return (packed.join(of, F.col("_s").eqNullSafe(F.col("_source")))
                .withColumn("_n", poisson_count(F.col("_table"), F.col("_parts"), uniform(seed, F.col("_id"))))
                .filter("_n > 0").select("_r", "_id", "_rate", "_n"))

    one = F.lit(1).cast("long")
    copies = drawn(rates.filter(F.col("_rate") <= COPIES)).select("_r", "_id", "_rate", F.explode(F.sequence(one, "_n")).alias("_copy"))
    often = rates.filter(F.col("_rate") > COPIES)
    if not often.isEmpty():
        # many copies of a row: dealt out in blocks first, so that no task makes them all
        blocks = drawn(often).select("*", F.explode(F.sequence(one, F.ceil(F.col("_n") / COPIES))).alias("_b"))
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        last = F.least(F.col("_n"), F.col("_b") * COPIES)
        copies = copies.unionByName(blocks.repartition(tasks, F.xxhash64("_id", "_b")).select(
            "_r", "_id", "_rate", F.explode(F.sequence((F.col("_b") - 1) * COPIES + 1, last)).alias("_copy")))
    copies = copies.withColumn("_copy", F.col("_copy").cast("int")).withColumn(
        "_order", F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_copy"))))
    dealt = copies.repartition("_order").sortWithinPartitions("_order")
    return dealt.select("_r.*", *(["_copy", "_rate", "_order"] if numbered else []))
