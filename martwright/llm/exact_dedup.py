"""Exact deduplication by progressive refinement.

1. *Length*: rows are counted per byte length; a length seen once is done.
2. *Prefix*: rows of the remaining lengths are counted per (length, hash of
   the first characters); a pair seen once is done.
3. *Full content*: only rows of the remaining pairs have their whole text
   hashed (SHA-256 of the normalised text) and are grouped on that digest.

Only ids and hashes are ever shuffled, never texts, and each count is a
partial aggregate, so a text copied into a third of all rows costs one
partial row per task.  Which lengths and pairs survive is carried from one
pass to the next as a bitmap of fixed size (``bits``, 256 KB by default): two
keys that share a bit merely make a row go on to the next stage, where the
next key, and in the end the digest, tells them apart.

Defined results: null text counts as empty (all empty texts are equal); null
ids are allowed and rank below every other id; of rows that repeat both id and
text exactly one is kept; an empty table gives an empty result; other columns
of the input, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap_table, in_bitmap, keep_rows, pin, row_key, whole_text


def _bitmap(counted: DataFrame, key: Column, bits: int) -> bytes:
    """Bitmap of the keys counted at least twice: one partial aggregate, at
    most bits/64 rows on the driver."""
    slot = F.pmod(key, F.lit(bits))
    words = (counted.filter(F.col("n") > 1)
             .groupBy(F.expr("0L").alias("z"), (F.floor(slot / 64)).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"),
                                           (slot % 64).cast("int"))).alias("b")))
    out = bytearray(bits // 8)
    for r in words.collect():
        at = int(r.w) * 8
        out[at:at + 8] = (r.b & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return bytes(out)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = 256, bits: int = 1 << 21,
                digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the row with the
    largest id stays.  ``text_sha256`` is null for rows that length or prefix
    already proved unique, unless ``digest_all`` asks for it."""
    text = whole_text(text_col)
    src = df.select(F.col(id_col).alias("_id"), text.alias("_text"))
    length = F.octet_length("_text")
    by_length = F.xxhash64(length)
    lengths = bitmap_table(df.sparkSession, _bitmap(src.groupBy(length.alias("len")).agg(F.count(F.lit(1)).alias("n")),
                                                    F.xxhash64("len"), bits))

    head = ascii_lower(F.substring("_text", 1, prefix_chars))
    by_prefix = F.xxhash64(length, head)
    prefixes = bitmap_table(df.sparkSession, _bitmap(src.filter(in_bitmap(lengths, bits, by_length))
                                                     .groupBy(by_prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")),
                                                     F.col("p"), bits))

    survives = in_bitmap(lengths, bits, by_length) & in_bitmap(prefixes, bits, by_prefix)
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    rows = pin(src.select("_id", F.monotonically_increasing_id().alias("_row"),
                          survives.alias("_open"),
                          (digest if digest_all else F.when(survives, digest)).alias("_sha")))

    open_rows = rows.filter("_open")
    # pinned, so that the join's exchanges serve the join alone and a hot digest can be split
    groups = pin(open_rows.groupBy("_sha")
                 .agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count(F.lit(1)).alias("_n")))
    found = open_rows.join(groups, "_sha").select(
        "_id", F.col("_top._id").alias("_keep"), "_n",
        (F.col("_row") == F.col("_top._row")).alias("_kept"), "_sha")
    alone = rows.filter("not _open").select(
        "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"),
        F.lit(True).alias("_kept"), "_sha")
    return found.unionByName(alone).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_dedup` keeps, with all columns."""
    keyed = df.select(F.struct(*row_key(id_col, text_col)).alias("_key"), whole_text(text_col).alias("_text"))
    decided = pin(exact_dedup(keyed, "_key", "_text").groupBy("_key")
                  .agg(F.max("kept").alias("_keep"), F.count(F.lit(1)).alias("_n"))
                  .select("_key.*", "_keep", "_n"))
    return keep_rows(df, decided, id_col, text_col)
