"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across,
so the place between its two bytes is a certain cut.  The text is cut at all
such places, the fragments are encoded independently (each distinct fragment
once per task, by the tokenizers library) and their ids concatenated.

Cuts are kept off the places where the library's own pre-splitting looks
across them, so that a fragment is pre-split as it is inside the whole text:
* only between characters, never inside one;
* never after white space (a run of it is split by what follows);
* before an apostrophe only after an ASCII letter or digit, and never inside
  the contractions the splitting pattern names.
Special tokens are found first, as the library does.

The table of certain cuts is derived from the vocabulary file when a task
starts; nothing is trained and the file is never copied.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

#: white space outside ASCII (fixed values, Unicode property White_Space)
ODD_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: contractions the pre-splitting pattern names (fixed values)
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
#: distinct fragments remembered per Python worker, in two halves: when the newer is full,
#: the older is given up, so that what keeps coming back stays
REMEMBER = 500_000
#: new fragments handed to the library as one text, with a special token between them
TOGETHER = 200
#: output is handed back once a batch holds this many text and id bytes
FLUSH_BYTES = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryCodec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        split = conf.get("pre_tokenizer") or {}
        if conf.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") \
                or not split.get("use_regex", True) or conf["model"].get("type") != "BPE":
            raise ValueError("needs a byte-level BPE file without normaliser or prefix space")
        added = conf.get("added_tokens", [])
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        alphabet = byte_alphabet()
        names = conf["model"]["vocab"]
        special = {t["content"]: t["id"] for t in added}
        self.size = max([*names.values(), *special.values()]) + 1
        self.bytes = [b""] * self.size
        inside = np.zeros((256, 256), dtype=bool)
        for name, i in names.items():
            b = bytes(alphabet[c] for c in name)
            self.bytes[i] = b
            for pair in zip(b, b[1:], strict=False):
                inside[pair] = True
        for name, i in special.items():
            self.bytes[i] = name.encode()
        self.special = {s.encode(): np.uint32(i).tobytes() for s, i in special.items()}
        # longest first at the same place, as the library matches them
        self.find_special = re.compile(b"(" + b"|".join(
            re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        self.cut = self._cuts(inside)
        narrow = self.cut.reshape(256, 256).copy()
        narrow[0x80:] = False
        self.cut_ascii = narrow.ravel()
        self.known: dict[bytes, bytes] = dict(self.special)
        self.before: dict[bytes, bytes] = {}

    @staticmethod
    def _cuts(inside: np.ndarray) -> np.ndarray:
        cut = ~inside
        cut[:0x21] = False                 # never after white space or control characters
        cut[:, 0x80:0xC0] = False          # never inside a character
        cut[0xC0:] = False
        before = cut[:, 0x27].copy()       # apostrophe: only after ASCII letters and digits
        cut[:, 0x27] = False
        for c in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]:
            cut[c, 0x27] = before[c]
        for c in CONTRACTIONS:
            b = c.encode()
            for i in range(len(b) - 1):
                cut[b[i], b[i + 1]] = False
        return cut.ravel()

    def fragments(self, text: str) -> list[bytes]:
        """The text in UTF-8, cut at every certain boundary."""
        data = text.encode("utf-8", "surrogatepass")
        return [data[i:j] for i, j in pairwise([0, *self._ends(text, data).tolist()])]

    def _ends(self, text: str, data: bytes) -> np.ndarray:
        """Where the text's fragments end in ``data``, the text in UTF-8."""
        cut = self.cut if text.isascii() or not ODD_SPACE.search(text) else self.cut_ascii
        if any(s in data for s in self.special):
            out = []
            for p in self.find_special.split(data):
                if p:
                    out.append((out[-1][-1] if out else 0) + self._piece_ends(p, None if p in self.special else cut))
            return np.concatenate(out)
        return self._piece_ends(data, cut)

    @staticmethod
    def _piece_ends(data: bytes, cut: np.ndarray | None) -> np.ndarray:
        if len(data) < 2 or cut is None:
            return np.array([len(data)] if data else [], dtype=np.int64)
        a = np.frombuffer(data, dtype=np.uint8)
        pair = a[:-1].astype(np.uint16)
        pair <<= 8
        pair |= a[1:]
        return np.append(np.flatnonzero(cut[pair]) + 1, len(a))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text (uint32).  The fragments of all texts are told apart by Arrow,
        without an object for each, and only the distinct ones looked up or encoded."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        cut = [self._ends(t, d) for t, d in zip(texts, data, strict=True)]
        starts = accumulate(map(len, data), initial=0)
        ends = np.concatenate([np.zeros(1, dtype=np.int64), *(e + i for e, i in zip(cut, starts, strict=False))])
        every = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(data))]).dictionary_encode()
        at, flat = every.dictionary.buffers()[1:]
        at = np.frombuffer(at, dtype=np.int64)[:len(every.dictionary) + 1].tolist()
        flat = flat.to_pybytes() if flat else b""
        distinct = [flat[i:j] for i, j in pairwise(at)]
        if 2 * len(self.known) > REMEMBER:
            self.known, self.before = dict(self.special), self.known
        known = self.known
        ids = list(map(known.get, distinct))
        if gaps := [i for i, x in enumerate(ids) if x is None]:
            new = [distinct[i] for i in gaps]
            again = {f: x for f in new if (x := self.before.get(f)) is not None}
            known.update(again)
            todo = [f for f in new if f not in again]
            for i in range(0, len(todo), TOGETHER):
                known.update(zip(todo[i:i + TOGETHER], self._encode_each(todo[i:i + TOGETHER]), strict=True))
            for i in gaps:
                ids[i] = known[distinct[i]]
        found = pa.array(ids, pa.large_binary()).take(every.indices)
        at, flat = found.buffers()[1:]
        at = np.frombuffer(at, dtype=np.int64)[:len(found) + 1] // 4
        flat = np.frombuffer(flat or b"", dtype=np.uint32)
        return [flat[at[i]:at[j]] for i, j in pairwise(accumulate(map(len, cut), initial=0))]

    def _encode_each(self, fragments: list[bytes]) -> list[bytes]:
        """Ids of each fragment by the library.  The library takes special tokens out
        first and what stands between them by itself, so one text of all the
        fragments, none of which holds a special token, gives the ids of each."""
        texts = [f.decode("utf-8", "surrogatepass") for f in fragments]
        if self.special:
            mark, number = next(iter(self.special.items()))
            ids = np.array(self.tok.encode_batch_fast([mark.decode().join(texts)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            at = np.flatnonzero(ids == np.frombuffer(number, dtype=np.uint32)[0]).tolist()
            if len(at) == len(texts) - 1:  # else a fragment's end and the mark made up another special token
                data = ids.tobytes()
                return [data[4 * i + 4:4 * j] for i, j in zip([-1, *at], [*at, len(ids)], strict=True)]
        return [np.array(e.ids, dtype=np.uint32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids) -> str:
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One codec per Python worker and vocabulary file."""
    return ForcedBoundaryCodec(path)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of a few MB of text (a single longer text: alone)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths + 64) // FLUSH_BYTES
    start = 0
    for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     decode: bool = True) -> DataFrame:
    """``id_col, ids array<int>`` and, with ``decode``, ``decoded`` (the text
    that the ids stand for), one row per input row in any order.

    Null and empty texts give no ids and an empty text; repeated rows are
    encoded each; other columns take no part; an empty table gives an empty
    result.  Memory per task: a few MB of text at a time, or one text if longer."""
    src = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            for part in slices(batch, "_text"):
                ids = c.encode_all(part.column("_text").to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
                out = [part.column("_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))]
                if decode:
                    out.append(pa.array([c.decode(i.tolist()) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["_id", "ids", "decoded"][:len(out)])

    schema = f"_id {kind}, ids array<int>" + (", decoded string" if decode else "")
    return map_arrow(src, run, schema).withColumnRenamed("_id", id_col)


def decode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, decoded`` from arrays of ids (null: empty text)."""
    src = df.select(F.col(id_col).alias("_id"), F.col(ids_col).cast("array<int>").alias("_ids"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for batch in batches:
            texts = [c.decode(i or []) for i in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(texts, pa.string())], names=["_id", "decoded"])

    return map_arrow(src, run, f"_id {kind}, decoded string").withColumnRenamed("_id", id_col)
