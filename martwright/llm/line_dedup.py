"""Line deduplication with two Bloom filters.

1. *Seen once, seen twice.*  Each task hashes the lines of its texts; the slots
   of a line's hash are marked in the first filter, and in the second when they
   were marked before.  Filters of two tasks merge by rule: marked twice is what
   either has twice, or both have once.  A task sends its slots block by block,
   sparse; a block's parts are merged as a stream, whatever their number.
2. *Suspects.*  Only lines whose slots are all marked twice can repeat.  They, and
   no others, are shuffled: a SHA-256 of the line and the id of its document.
3. *Confirmation.*  Suspects are counted exactly, documents per digest, and the
   document that keeps the line is chosen.
4. *Rewriting.*  Documents that lose a line meet the list of their lost lines; all
   other texts stay where they are.

A false alarm of a filter costs a shuffled digest, never a line.  Filters have
about ``BITS_PER_LINE`` bits a line up to ``max_bits``; beyond that more lines
are suspected, and the result is the same.  Every count is reduced in the
tasks first and a hot line's rows are spread by document, so one line in a
third of all documents is no task of its own.

Defined results: null and empty texts are one empty line; a line is compared
without the ASCII white space at its ends and with A-Z lower-cased; documents are
told apart by id, so repeated rows of an id are one document, and all rows
without an id are one that ranks below all others; within the document that
keeps a line all its occurrences stay; a text that loses all lines is empty; an
empty table gives an empty result; other columns are carried whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_table, in_bitmap, key_bitmap, map_arrow, pin, row_key, whole_text

#: white space taken off the ends of a line
BLANKS = " \t\n\x0b\x0c\r"
#: hash functions of the filters, and their bits a line
HASHES, BITS_PER_LINE = 3, 8
#: bits of a block, the unit in which filters are merged
BLOCK = 1 << 16
#: slots gathered in a task before they are handed on
FLUSH = 1 << 21


def line_key(line: str, min_chars: int) -> bytes | None:
    """What lines are compared by, in UTF-8: no white space at the ends, A-Z
    lower-cased; None for a line that is too short to count."""
    s = line.strip(BLANKS)
    return s.encode("utf-8", "surrogatepass").lower() if len(s) >= min_chars else None


def long_keys(text: str, min_chars: int) -> set[bytes]:
    """Distinct keys of the text's lines that are long enough."""
    return {k for line in text.split("\n") if (k := line_key(line, min_chars)) is not None}


def slots(keys: list[bytes], bits: int) -> np.ndarray:
    """(len(keys), HASHES) slots of a power of two ``bits`` (double hashing)."""
    import xxhash
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return (h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _filter_parts(texts: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """``block, once, twice``: slots of each task's lines as sorted places in their blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def handed() -> pa.RecordBatch:
            at, times = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
            block = (at // BLOCK).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(at) else np.empty(0, np.int64)
            ends = np.r_[cuts[1:], len(at)] if len(at) else cuts
            place = (at % BLOCK).astype(np.uint16)
            return pa.RecordBatch.from_arrays(
                [pa.array(block[cuts], pa.int64()),
                 pa.array([place[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                 pa.array([place[a:b][times[a:b] > 1].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())],
                names=["block", "once", "twice"])

        for b in batches:
            keys = [k for t in b.column("_text") for k in long_keys(t.as_py(), min_chars)]
            if keys:
                # a line marks a slot once, though two of its hashes may fall together
                s = np.sort(slots(keys, bits), axis=1)
                held.append(s[np.c_[np.ones(len(s), bool), s[:, 1:] != s[:, :-1]]])
                size += len(held[-1])
            if size > FLUSH:
                yield handed()
                held, size = [], 0
        yield handed()

    return map_arrow(texts, run, "block long, once binary, twice binary")


def _merge_blocks(parts: DataFrame) -> DataFrame:
    """``block, twice``: the second filter's blocks, each merged from its parts one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice = None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())],
                                              names=["block", "twice"])

        for b in batches:
            for block, o, t in zip(b.column("block").to_pylist(), b.column("once"), b.column("twice"), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, once, twice = block, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)
                o = np.frombuffer(o.as_py(), np.uint16)
                twice[o[once[o]]] = True
                once[o] = True
                twice[np.frombuffer(t.as_py(), np.uint16)] = True
        if now is not None:
            yield done()

    dealt = parts.repartition("block").sortWithinPartitions("block")
    return map_arrow(dealt, run, "block long, twice binary")


def twice_filter(texts: DataFrame, min_chars: int, max_bits: int) -> np.ndarray:
    """Bits of the second filter, packed: at most ``max_bits / 8`` bytes, whatever the input."""
    lines = texts.agg(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"))) + 1).alias("n")).first().n or 0
    bits = max(BLOCK, min(max_bits, 1 << int(lines * BITS_PER_LINE).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    for r in _merge_blocks(_filter_parts(texts, bits, min_chars)).toLocalIterator():
        out[r.block * (BLOCK // 8):(r.block + 1) * (BLOCK // 8)] = np.frombuffer(bytes(r.twice), np.uint8)
    return out


def suspected(keys: list[bytes], marked: np.ndarray) -> np.ndarray:
    """Positions of those keys whose slots are all marked."""
    s = slots(keys, len(marked) * 8)
    return np.flatnonzero(((marked[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                   min_documents: int = 3, max_bits: int = 1 << 30) -> DataFrame:
    """``_id, _th, _line``: digests of the lines that the rows with this key (see
    :func:`~.common.row_key`) lose, each once."""
    src = df.select(*row_key(id_col, text_col), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    marked = df.sparkSession.sparkContext.broadcast(twice_filter(src.select("_text"), min_chars, max_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, of = [], []
            for j, t in enumerate(b.column("_text")):
                own = long_keys(t.as_py(), min_chars)
                keys += own
                of += [j] * len(own)
            hit = suspected(keys, marked.value)
            at = pa.array([of[i] for i in hit], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("_id").take(at), b.column("_th").take(at),
                 pa.array([hashlib.sha256(keys[i]).digest() for i in hit], pa.binary())], names=["_id", "_th", "_line"])

    rows = pin(map_arrow(src, run, f"_id {kind}, _th long, _line binary"))
    # spread by line and document first, then reduced to one row a line in each task
    per_line = (rows.groupBy("_line", "_id").agg(F.lit(1).alias("_one"))
                .groupBy("_line").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")))
    lost = pin(per_line.filter(F.col("_n") >= min_documents).select("_line", "_keep"))
    return (rows.join(lost, "_line").filter(~F.col("_id").eqNullSafe(F.col("_keep")))
            .select("_id", "_th", "_line").distinct())


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_documents: int = 3, max_bits: int = 1 << 30) -> DataFrame:
    """All rows and columns of ``df``, the text without the lines that
    ``min_documents`` or more documents hold (they stay in the document of the
    largest id), and ``_n_lines`` (before), ``_n_dropped``."""
    rest = [c for c in df.columns if c != text_col]
    lost = pin(repeated_lines(df, id_col, text_col, min_chars, min_documents, max_bits)
               .groupBy("_id", "_th").agg(F.collect_list("_line").alias("_lost")))
    made = key_bitmap(lost.select("_th"), "_th")
    hit = in_bitmap(bitmap_table(df.sparkSession, made), len(made) * 8, F.col("_h"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_r"), whole_text(text_col).alias("_t"),
                     *[c.alias(n) for c, n in zip(row_key(id_col, text_col), ("_i", "_h"), strict=True)])
    whole = rows.filter(~hit).select(
        "_r", "_t", (F.length("_t") - F.length(F.replace("_t", F.lit("\n"))) + 1).cast("long").alias("_n_lines"),
        F.lit(0).cast("long").alias("_n_dropped"))
    met = rows.filter(hit).join(lost, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, before, gone = [], [], []
            for t, g in zip(b.column("_t"), b.column("_lost").to_pylist(), strict=True):
                lines, g = t.as_py().split("\n"), set(g or ())
                stay = [x for x in lines if (k := line_key(x, min_chars)) is None or hashlib.sha256(k).digest() not in g] if g else lines
                kept.append("\n".join(stay))
                before.append(len(lines))
                gone.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([b.column("_r"), pa.array(kept, pa.string()), pa.array(before, pa.int64()), pa.array(gone, pa.int64())],
                                             names=["_r", "_t", "_n_lines", "_n_dropped"])

    both = whole.unionByName(map_arrow(met.select("_r", "_t", "_lost"), run, whole.schema))
    return both.select(*[F.col("_t").alias(c) if c == text_col else F.col(f"_r.`{c}`") for c in df.columns], "_n_lines", "_n_dropped")
