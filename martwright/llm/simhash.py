"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each document gets a 64-bit SimHash of its word shingles.  Two fingerprints
that differ in at most r bits have a value half way between them, so every
*distinct* fingerprint emits all variants within half the radius (65 for r =
2) and the variants are shuffled: fingerprints that meet on a variant are
candidates, deduplicated and verified by counting differing bits.

At most one ball of distinct fingerprints can meet on a variant (65 for r =
2), as copies were reduced to one fingerprint before, so no bucket is large
and none is capped.  All that meet are within r of each other, so linking
each to the smallest one present keeps every component without writing out
all pairs.  For odd r one end emits the larger half; the centre of a bucket
is then the smallest fingerprint that is near enough to reach all others.

Defined results: null text counts as empty; a text without words has
fingerprint zero, linked like any other; a text of fewer words than a shingle
is one shingle; null ids are allowed and never are a component id while the
component has another; repeated rows are rows of the same component; an empty
table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep_rows, map_arrow, pin, row_key, whole_text
from .components import component_roots

BITS = 64
#: shingles whose bits are counted at a time
CHUNK = 1 << 15


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the text: A-Z lower-cased, split at ASCII white space,
    shingles with repeats hashed by XXH64; a bit is 1 if set in over half."""
    import xxhash
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) < words:
        shingles, n = [b" ".join(w)], 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), len(w) - words + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, CHUNK):
        part = h[i:i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words: int = 3, seed: int = 42) -> DataFrame:
    """``_id, _th, _fp`` (fingerprint as a signed 64-bit integer), a row per row."""
    src = df.select(*row_key(id_col, text_col), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column("_text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_th"), pa.array(fp.view(np.int64))],
                                             names=["_id", "_th", "_fp"])

    return map_arrow(src, run, f"_id {kind}, _th long, _fp long")


def _masks(within: int) -> list[int]:
    """All 64-bit words with at most ``within`` bits set, as signed integers, by number of bits."""
    out = [sum(1 << i for i in c) for k in range(within + 1) for c in combinations(range(BITS), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def ball_edges(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``u, v`` links that connect every two of the distinct fingerprints
    ``_fp`` at most ``radius`` bits apart (through others where more than two
    meet on a variant)."""
    reach, near = (radius + 1) // 2, len(_masks(radius // 2))
    masks = F.array(*[F.lit(m) for m in _masks(reach)])
    # a small table becomes many rows: spread it over all tasks first
    spread = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_fp")
    variants = spread.select("_fp", F.posexplode(masks).alias("_k", "_mask")).select(
        F.col("_fp").bitwiseXOR(F.col("_mask")).alias("_variant"), "_fp",
        *([] if radius % 2 == 0 else [(F.col("_k") < near).alias("_near")]))
    centre = F.col("_fp") if radius % 2 == 0 else F.when(F.col("_near"), F.col("_fp"))
    met = variants.withColumn("_centre", F.min(centre).over(Window.partitionBy("_variant")))
    return (met.filter((F.col("_centre") != F.col("_fp"))
                       & (F.bit_count(F.col("_centre").bitwiseXOR(F.col("_fp"))) <= radius))
            .select(F.col("_fp").alias("u"), F.col("_centre").alias("v")).distinct())


def simhash_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``_fp, _component`` (smallest ``_id`` reachable) from pinned rows ``_id, _fp``."""
    distinct = pin(prints.groupBy("_fp").agg(F.min("_id").alias("_first")))
    roots = component_roots(ball_edges(distinct.select("_fp"), radius))
    placed = distinct.join(roots, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    first = placed.groupBy("_root").agg(F.min("_first").alias("_component"))
    return placed.join(first, "_root").select("_fp", "_component")


def simhash_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                  radius: int = 2) -> DataFrame:
    """One row per input row: ``id_col, fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links of at most ``radius`` bits)."""
    prints = pin(fingerprints(df, id_col, text_col, words))
    comp = pin(simhash_components(prints, radius))
    return prints.join(comp, "_fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                     radius: int = 2) -> DataFrame:
    """The rows of ``df``, all columns, one for each component: that of the smallest id."""
    prints = pin(fingerprints(df, id_col, text_col, words))
    comp = pin(simhash_components(prints, radius))
    keyed = prints.groupBy("_id", "_th").agg(F.first("_fp").alias("_fp"), F.count(F.lit(1)).alias("_n"))
    placed = pin(keyed.join(comp, "_fp"))
    best = placed.groupBy("_component").agg(
        F.min(F.struct(F.col("_id").isNull().alias("z"), "_id", "_th")).alias("_best"))
    best = best.select(F.col("_best._id").alias("_bid"), F.col("_best._th").alias("_bth"))
    decided = pin(placed.join(best, F.col("_id").eqNullSafe(F.col("_bid")) & (F.col("_th") == F.col("_bth")), "left")
                  .select("_id", "_th", F.col("_bth").isNotNull().alias("_keep"), "_n"))
    return keep_rows(df, decided, id_col, text_col)
