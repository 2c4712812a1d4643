"""Helpers shared by the corpus operators: text normalisation, pinned
intermediate results and files in the folder all executors share."""

from __future__ import annotations

import ctypes
import gc
import os
import platform
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def whole_text(name: str) -> Column:
    """The text column, null read as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: folders of the pins made inside :func:`scratch`, innermost last
_OPEN: list[list[str]] = []


def pin(df: DataFrame) -> DataFrame:
    """Write a (narrow) intermediate result as a table below the shared
    checkpoint folder and read it again: it is computed once, outlives the
    executors that made it, and its true size is known to the planner."""
    spark = df.sparkSession
    path = shared_folder(spark, "pin")
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is pinned inside is deleted at the end: for work whose own result has been
    pinned by then.  Paths taken off the list stay."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        for path in _OPEN.pop():
            delete_folder(spark, path)


def delete_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a fresh folder below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    if "://" not in base:
        base = "file://" + base.removeprefix("file:")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str):
    """(file system, path) of a URI, on the driver or inside a task.  Executors
    reach the shared folder through pyarrow's file systems (file, hdfs, s3, gs)."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_martwright_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    made = os.path.join(tempfile.mkdtemp(prefix="martwright-"), "martwright_package.zip")
    with zipfile.ZipFile(made, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("martwright", os.path.relpath(full, root)))
    sc.addPyFile(made)
    sc._martwright_shipped = True


def map_arrow(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand in the executors; a task's memory is
    given back at its end."""
    ship_package(df.sparkSession)

    def released(batches):
        yield from run(batches)
        release_memory()
    return df.mapInArrow(released, schema)


def release_memory() -> None:
    """Give what a finished task has freed back to the system: a Python worker lives on
    for later stages, beside the tasks of the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and platform.libc_ver()[0] == "glibc":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """``_id, _th``: what tells rows of a documents table apart; rows equal in
    both repeat each other."""
    return [F.col(id_col).alias("_id"), F.xxhash64(whole_text(text_col)).alias("_th")]


def key_hash(id_col: str, hash_col: str) -> Column:
    """One 64-bit hash of a row's key (see :func:`row_key`)."""
    return F.xxhash64(F.col(id_col), F.col(hash_col))


def keep_rows(df: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``df``, all columns, whose key ``decided`` (``_id, _th, _keep``
    and ``_n``, the rows with that key; pinned; every key of ``df``) keeps; of rows
    that repeat a kept key, one.

    The texts stay where they are: which keys go is told to the tasks by a
    cascade of bitmaps (:func:`told_apart`), and only what it leaves open, beyond
    the bitmaps' greatest size, is joined."""
    cols = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_r"),
                     *[c.alias(n) for c, n in zip(row_key(id_col, text_col), ("_i", "_t"), strict=True)])
    keyed = decided.select("_id", "_th", "_keep", key_hash("_id", "_th").alias("_h"))
    # two keys of one hash that are not decided alike are left open, whatever the bitmaps say
    mixed = pin(keyed.groupBy("_h").agg(F.min("_keep").alias("a"), F.max("_keep").alias("b")).filter("a != b").select("_h"))
    goes, open_to = told_apart(pin(keyed.filter("not _keep").select("_h")), pin(keyed.filter("_keep").select("_h")),
                               key_hash("_i", "_t"))

    def hit(keys: DataFrame, how: str, left: DataFrame) -> DataFrame:
        return left.join(keys.select("_id", "_th"),
                         F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), how)

    if open_to is None and mixed.isEmpty():
        left = rows.filter(~goes)
    else:
        gone = pin(keyed.filter("not _keep").select("_id", "_th"))
        left = hit(gone, "left_anti", rows)
        if open_to is not None and mixed.isEmpty():
            left = rows.filter(~open_to & ~goes).unionByName(hit(gone, "left_anti", rows.filter(open_to)))
    twice = pin(decided.filter("_keep and _n > 1").select("_id", "_th"))
    if twice.isEmpty():
        return left.select("_r.*")
    many = hit(twice, "left_semi", left).groupBy("_i", "_t").agg(F.first("_r").alias("_r"))
    return hit(twice, "left_anti", left).select("_r").unionByName(many.select("_r")).select("_r.*")


def told_apart(yes: DataFrame, no: DataFrame, key: Column, levels: int = 12) -> tuple[Column, Column | None]:
    """(whether a key is of ``yes``, whether that stays open) for keys that are all
    of ``yes`` or ``no`` (pinned tables of one hash ``_h``).

    A cascade of bitmaps: the first holds ``yes``; the second those of ``no`` that
    hit the first; the third those of ``yes`` that hit the second, and so on, each
    with another hash, until nothing hits.  The first bitmap that a key misses
    tells its side, without error.  Where the tables outgrow the bitmaps, keys that
    hit all of the ``levels`` stay open."""
    maps: list[Column] = []
    a, b = yes, no
    for level in range(levels):
        here = F.xxhash64(F.col("_h"), F.lit(level))
        made = key_bitmap(a.select(here.alias("_k")), "_k", per_row=16)
        held, bits = bitmap_table(yes.sparkSession, made), len(made) * 8
        maps.append(in_bitmap(held, bits, F.xxhash64(key, F.lit(level))))
        a, b = pin(b.filter(in_bitmap(held, bits, here))), a
        if a.isEmpty():
            break
    last = len(maps) % 2 == 1          # hits all: of the table that the last bitmap holds
    out = F.lit(last)
    for i in reversed(range(len(maps))):
        out = F.when(maps[i], out).otherwise(F.lit(i % 2 == 1))
    open_to = None
    if not a.isEmpty():
        open_to = maps[0]
        for m in maps[1:]:
            open_to = open_to & m
    return out, open_to


def key_bitmap(keys: DataFrame, col: str, most: int = 1 << 24, per_row: int = 8) -> bytes:
    """Bitmap of the 64-bit hashes in ``col`` of a pinned table: at least ``per_row``
    bits a row, but ``most`` (2 MB) in all, however many rows there are."""
    bits = max(1 << 12, min(most, 1 << (per_row * keys.count()).bit_length()))
    slot = F.pmod(F.col(col), F.lit(bits))
    words = (keys.groupBy(F.floor(slot / 64).alias("w"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("b")))
    out = bytearray(bits // 8)
    for r in words.toLocalIterator():
        out[int(r.w) * 8:int(r.w) * 8 + 8] = (r.b & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    return bytes(out)


def bitmap_table(spark: SparkSession, bitmap: bytes) -> Column:
    """The bitmap as a value of queries, read by a scalar subquery from a table of one row:
    a literal would be written out, in hexadecimal digits, wherever the driver keeps or
    reports a plan that holds it, once for each of its operators."""
    return spark.createDataFrame(pa.table({"_bits": pa.array([bitmap], pa.binary())})).scalar()


def in_bitmap(bitmap: Column, bits: int, key: Column) -> Column:
    """Whether the hash's bit is set in the bitmap (of so many bits, see :func:`bitmap_table`):
    true for every key of the bitmap, and for a few others."""
    slot = F.pmod(key, F.lit(bits))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(slot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int"))) != 0


def hash_sample(df: DataFrame, key: Column, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (a little fewer; all, if there are no more),
    those whose hash is small: the same on every run, without a sort."""
    total = df.count()
    share = (rows - 4 * rows ** 0.5) / max(1, total)
    if total <= rows:
        return df
    cells = 1 << 30
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(cells)) < F.lit(int(share * cells)))
