"""Token ids as flat binary files with 64-bit document offsets.

Documents are encoded where they lie, dealt by id range to one partition per
file (``repartitionById``, so that a range is a file), sorted there and
written as they stream past:

* ``*.bin``  the ids of all documents, flat unsigned integers, little endian,
  16 bits wide where the vocabulary allows it, else 32;
* ``*.off``  64-bit offsets, one per document and one more: document i has
  the ids ``off[i] : off[i+1]`` of its file;
* ``*.doc``  the document ids as an Arrow file, nulls included;
* ``manifest/``  a table with one row per file: names, width, documents, ids
  and ``base``, the ids in all files before it: a prefix sum over files.

A reader maps a file into memory and touches only what it needs.  Each write
attempt uses names of its own and the manifest lists those of the attempts
that succeeded, so a lost executor or a speculative copy leaves nothing wrong.

Defined results: null ids come first; ties of an id stand in the order of
their ids' bytes; a null or empty text is a document that holds the end id
alone; an empty table gives an empty manifest and no rows; other columns take
no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import codec, slices
from .common import map_arrow, open_store, pin, shared_folder, whole_text

MANIFEST = "_range int, bin string, off string, doc string, width int, docs long, tokens long"
#: documents handed back at a time by the reader, and the ids after which a batch ends
READ_DOCS, READ_IDS = 4096, 2 << 20


def id_bounds(df: DataFrame, id_col: str, files: int) -> list[int]:
    """Ids that split the rows into about equal ranges (one small aggregate)."""
    if files < 2:
        return []
    shares = [i / files for i in range(1, files)]
    got = df.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, max(10_000, 20 * files)).alias("b")).first().b
    return sorted(set(got or []))


def encoded_ranges(df: DataFrame, tokenizer_path: str, bounds: list[int], id_col: str, text_col: str,
                   end_id: int | None) -> DataFrame:
    """``_id, _range, _n, _ids`` (ids as little-endian binary)."""
    src = df.select(F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        kind = np.dtype("<u2" if c.size <= 1 << 16 else "<u4")
        tail = np.array([] if end_id is None else [end_id], dtype=kind).tobytes()
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = [i.astype(kind).tobytes() + tail for i in c.encode_all(part.column("_text").to_pylist())]
                at = [0 if i is None else int(np.searchsorted(bounds, i, side="right"))
                      for i in part.column("_id").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(at, pa.int32()),
                     pa.array([len(i) // kind.itemsize for i in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["_id", "_range", "_n", "_ids"])

    return map_arrow(src, run, "_id long, _range int, _n long, _ids binary")


def write_token_files(df: DataFrame, tokenizer_path: str, folder: str | None = None, id_col: str = "doc_id",
                      text_col: str = "text", end_id: int | None = 0, files: int | None = None) -> str:
    """Encode, write the files below ``folder`` (default: a fresh one in the
    shared checkpoint folder) in ascending id order, and return it."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = id_bounds(df, id_col, files)
    width = 2 if codec(tokenizer_path).size <= 1 << 16 else 4
    rows = (encoded_ranges(df, tokenizer_path, bounds, id_col, text_col, end_id)
            .repartitionById(len(bounds) + 1, F.col("_range"))
            .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_ids"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                at = batch.column("_range")[0].as_py()
                names = [f"part-{at:06d}-{uuid.uuid4().hex}.{x}" for x in ("bin", "off", "doc")]
                fs.create_dir(path, recursive=True)
                out = [fs.open_output_stream(f"{path}/{n}") for n in names]
                ids = pa.ipc.new_file(out[2], pa.schema([("doc_id", pa.int64())]))
                out[1].write(np.zeros(1, dtype="<i8").tobytes())
                docs = tokens = 0
            for x in batch.column("_ids"):
                out[0].write(x.as_buffer())
            ends = tokens + np.cumsum(batch.column("_n").to_numpy())
            out[1].write(ends.astype("<i8").tobytes())
            ids.write_batch(pa.RecordBatch.from_arrays([batch.column("_id")], names=["doc_id"]))
            docs, tokens = docs + batch.num_rows, int(ends[-1])
        if out is not None:
            ids.close()
            for o in out:
                o.close()
            yield pa.RecordBatch.from_pylist([{"_range": at, "bin": names[0], "off": names[1], "doc": names[2],
                                              "width": width, "docs": docs, "tokens": tokens}],
                                             schema=pa.schema([("_range", pa.int32()), ("bin", pa.string()),
                                                               ("off", pa.string()), ("doc", pa.string()),
                                                               ("width", pa.int32()), ("docs", pa.int64()),
                                                               ("tokens", pa.int64())]))

    made = pin(map_arrow(rows, write, MANIFEST))
    # one row per file: the window's single task holds as many rows as there are files
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    (made.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))
         .write.mode("overwrite").parquet(f"{folder}/manifest"))
    return folder


def _mapped(fs, path: str) -> np.ndarray:
    """Bytes of a file: memory-mapped where the shared folder is mounted."""
    from pyarrow import fs as pafs
    if isinstance(fs, pafs.LocalFileSystem):
        return np.frombuffer(pa.memory_map(path).read_buffer(), dtype=np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=np.uint8)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_u32`` (the ids as little-endian unsigned 32-bit integers) of every
    document, one task per file."""
    files = spark.read.parquet(f"{folder}/manifest")
    n = max(1, files.count())
    order = files.withColumn("_at", F.pmod(F.col("_range"), F.lit(n)).cast("int")).repartitionById(n, F.col("_at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        for row in (r for b in batches for r in b.to_pylist()):
            off = _mapped(fs, f"{path}/{row['off']}").view("<i8")
            ids = _mapped(fs, f"{path}/{row['bin']}").view("<u2" if row["width"] == 2 else "<u4")
            with pa.ipc.open_file(fs.open_input_file(f"{path}/{row['doc']}")) as f:
                start = 0
                for k in range(f.num_record_batches):
                    docs = f.get_batch(k).column(0)
                    i = 0
                    while i < len(docs):
                        here = off[start + i:start + min(i + READ_DOCS, len(docs)) + 1]
                        m = max(1, int(np.searchsorted(here, here[0] + READ_IDS, side="right")) - 1)
                        here = here[:m + 1]
                        flat = ids[here[0]:here[-1]].astype("<u4").tobytes()
                        ends = (here - here[0]) * 4
                        yield pa.RecordBatch.from_arrays(
                            [docs.slice(i, m), pa.array(here[:-1] + row["base"]), pa.array(np.diff(here)),
                             pa.array([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_u32"])
                        i += m
                    start += len(docs)

    return map_arrow(order, read, "doc_id long, start long, n_tokens long, ids_u32 binary")
