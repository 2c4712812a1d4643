"""Detection of periodic runs: stretches of words that repeat with a period.

A run is a maximal stretch whose words q apart are identical, q being its
smallest period, of at least ``MIN_WORDS`` words and ``MIN_PERIODS`` periods.

*Sparse diagonal DP.*  The diagonal of lag q holds the positions i whose word
equals the word q before.  Going through the words, each earlier occurrence
increments the match length of the lag it lies at; a lag that is not
incremented ends, and if its match is long enough (three periods: with the
first one, four) it is a run and is emitted there.

Taking every earlier occurrence of a frequent word would make this quadratic, so
the earlier occurrences are thinned without loss: a lag between g/2 and g (g a
power of two) counts only where the next g words occurred there as well, and
then only the *latest* such occurrence matters.  (In a run of smallest period
q, g >= q words cannot recur nearer than q: by Fine and Wilf's theorem the run
would have that smaller period.  Any stretch found at its latest lag is, for the
same reason, a run of smallest period, found at one g only.)  A position thus
increments one lag for every g, and those whose g words occur once in the
document drop out before the next g: the whole costs n log n at most and little
more than n for prose.

Documents are independent, a task sweeps over some hundred thousand words of
them at a time, and memory follows that or the longest document.

Defined results: null and empty texts have no words and no runs; words are
separated by ASCII white space and compared as they are; repeated rows are
reported each; ids may be null; an empty table gives an empty result; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, whole_text

#: least words and periods of a run
MIN_WORDS, MIN_PERIODS = 6, 4
#: words swept over at a time
SWEEP = 1 << 18


def find_runs(words: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the concatenated documents, sorted;
    ``words`` numbers the words, ``docs`` the document of each, ascending."""
    n = len(words)
    if n == 0:
        none = np.empty(0, np.int64)
        return none, none, none
    found = []
    name, g = docs * (int(words.max()) + 1) + words, 1
    pos = np.arange(n)  # positions whose g words stay within the document and recur in it
    while len(pos):
        order = np.argsort(name, kind="stable")
        same = name[order[1:]] == name[order[:-1]]
        lag, again, number = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool), np.empty(len(pos), np.int64)
        lag[order[1:][same]] = (pos[order[1:]] - pos[order[:-1]])[same]  # to the latest earlier occurrence
        again[order[1:][same]] = again[order[:-1][same]] = True
        number[order] = np.r_[0, np.cumsum(~same)]
        pos, lag, number = pos[again], lag[again], number[again]
        if not len(pos):
            break
        here = np.flatnonzero((lag > g // 2) & (lag <= g))
        if len(here):
            p, q = pos[here], lag[here]
            first = np.r_[True, (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1])]
            begin = np.flatnonzero(first)
            end = np.r_[begin[1:], len(p)] - 1
            q = q[begin]
            start = p[begin] - q
            length = p[end] + g - start
            long = length >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
            found.append(np.stack([start[long], length[long], q[long]]))
        # the next g: two such stretches side by side, both of which must recur
        at = np.searchsorted(pos, pos + g)
        at[at == len(pos)] = 0
        joined = (pos[at] == pos + g) & (docs[pos[at]] == docs[pos])
        pos, name = pos[joined], number[joined] * (int(number.max()) + 1) + number[at[joined]]
        g *= 2
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _sweep(ids: list, docs: list[list[bytes]]) -> list[tuple[list, bytes]]:
    """For each document its runs (start, length, period) and its words without the repetitions."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    base = np.r_[0, np.cumsum(sizes)]
    seen: dict[bytes, int] = {}
    words = np.fromiter((seen.setdefault(w, len(seen)) for d in docs for w in d), np.int64, int(base[-1]))
    start, length, period = find_runs(words, np.repeat(np.arange(len(docs)), sizes))
    # a word goes if a run holds it after that run's first period
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    stays = np.cumsum(depth)[:-1] == 0
    cut = np.searchsorted(start, base)
    out = []
    for j, d in enumerate(docs):
        a, b, at = int(cut[j]), int(cut[j + 1]), int(base[j])
        if a == b:
            out.append(([], b" ".join(d)))
            continue
        runs = [{"start": int(s) - at, "length": int(n), "period": int(q)}
                for s, n, q in zip(start[a:b], length[a:b], period[a:b], strict=True)]
        kept = stays[at:at + len(d)]
        out.append((runs, b" ".join([w for w, k in zip(d, kept, strict=True) if k])))
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rewrite: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """One row per row: ``id_col, n_words, runs`` (array of ``start, length,
    period``, in words, by start and period) and ``collapsed``, the words joined
    by one space without those that a run holds after its first period.
    ``rewrite(id as text, words)`` may replace the words first (for trials)."""
    src = df.select(F.col(id_col).alias("_id"), F.col(id_col).cast("string").alias("_said"), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            said = b.column("_said").to_pylist()
            while at < b.num_rows:
                docs, size, end = [], 0, at
                while end < b.num_rows and (size < SWEEP or end == at):
                    w = b.column("_text")[end].as_py().encode("utf-8", "surrogatepass").split()
                    if rewrite is not None:
                        w = rewrite(said[end], w)
                    docs.append(w)
                    size += len(w)
                    end += 1
                done = _sweep(said[at:end], docs)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_id").slice(at, end - at), pa.array([len(d) for d in docs], pa.int64()),
                     pa.array([r for r, _ in done], run_type), pa.array([t.decode("utf-8", "surrogatepass") for _, t in done], pa.string())],
                    names=["_id", "n_words", "runs", "collapsed"])
                at = end

    return map_arrow(src, run, f"_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
                     ).withColumnRenamed("_id", id_col)
