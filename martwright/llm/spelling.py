"""Spelling variants by a variable-length gram index.

*Words.*  Maximal runs of letters of every text, A-Z lower-cased, counted over
all rows; words of at least ``min_length`` code points and ``min_count``
occurrences take part.

*Gram dictionary.*  Grams start ``QMIN`` code points long and grow, up to
``QMAX``, as long as the gram so far is frequent: held by more than one word
position in ``RARE``.  Only the frequent grams need storing, and as each takes
a share of all positions, there are at most ``RARE`` of a length: the
dictionary is bounded whatever the corpus.

*Decomposition.*  From every code point of a word starts one gram, the shortest
that the dictionary does not call frequent.

*Affected grams.*  An edit at a place p can touch only grams that reach over p;
those that end before it and those that start after it stay, the former at the
same distance from the word's start, the latter from its end.  A word of at
least ``QMIN + QMAX + 1`` code points keeps at least one gram for every p.

*List merging.*  Whoever is one edit away is, for some p, on the lists of all
grams that p leaves untouched.  These lists are not counted through one by one,
as those of common grams hold a large part of the vocabulary: a posting is made
on the digest of the whole untouched sequence, one for every place of a word
(something stands there: replaced or inserted in the other) and one for every
gap (something is missing there).  Postings that meet are candidates.

*Verification.*  Candidates are compared in full around p.  A pair counts at the
first code point where the two words differ, hence once, however many places
they meet on.

Only postings are shuffled; lists hold words that agree but for a few code
points around one place, and a long list is split by the join.

Defined results: null text counts as empty; a null id is written ``null``;
repeated rows count each time; an empty table, or one without words that
qualify, gives an empty result; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, pin, whole_text

#: shortest and longest gram, in code points
QMIN, QMAX = 2, 4
#: a gram is frequent if it takes more than one word position in RARE
RARE = 300
#: words counted in a task before their counts are handed on
FLUSH = 200_000


#: every Latin-1 letter as it counts; all other signs as a blank
LETTERS = bytes(c if c >= 0xC0 else ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalpha() else 0x20 for c in range(256))


def long_runs(texts: list[str], least: int) -> list[list[bytes]]:
    """For each text its maximal runs of at least ``least`` letters, in Latin-1
    and A-Z lower-cased, in order (signs outside Latin-1 end a run like any other)."""
    plain = [t.encode("latin-1", "replace").translate(LETTERS) for t in texts]
    joined = b" " + b" ".join(plain) + b" "
    inside = np.frombuffer(joined, np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= least
    begin, end = begin[long], end[long]
    cuts = np.searchsorted(begin, np.cumsum([1] + [len(t) + 1 for t in plain]))
    words = [joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    return [words[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def word_counts(df: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int,
                typo_every: int | None) -> DataFrame:
    """``word, n``: words long and frequent enough, over all rows."""
    src = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_id"), whole_text(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[bytes, int] = defaultdict(int)

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()),
                                              pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                for i, found in zip(b.column("_id"), long_runs([t.as_py() for t in b.column("_text")], min_length), strict=True):
                    if typo_every is None:
                        for w in found:
                            total[w] += 1
                        continue
                    prefix = zlib.crc32(f"{i}:".encode())
                    for w, n in Counter(found).items():
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), prefix)
                        if h % typo_every == 0:
                            cut = h % len(w)
                            w = w[:cut] + w[cut + 1:]
                            if len(w) < min_length:
                                continue
                        total[w] += n
                if len(total) > FLUSH:
                    yield handed()
        yield handed()

    parts = map_arrow(src, run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def frequent_grams(words: DataFrame, rare: int = RARE) -> set[str]:
    """Grams of ``QMIN`` to ``QMAX - 1`` code points that take more than one
    position in ``rare`` among all positions of their length."""
    def of(q: int):
        return F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda i: F.substring("word", i, F.lit(q)))

    grams = (words.select(F.explode(F.flatten(F.array(*[of(q) for q in range(QMIN, QMAX)]))).alias("g"))
             .groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    counted = pin(grams)
    places = {r.q: r.n for r in counted.groupBy(F.length("g").alias("q")).agg(F.sum("n").alias("n")).collect()}
    least = F.element_at(F.create_map(*[F.lit(v) for kv in places.items() for v in kv]), F.length("g")) if places else F.lit(0)
    return {r.g for r in counted.filter(F.col("n") * rare > least).select("g").collect()}


def decompose(word: str, frequent: set[str]) -> tuple[list[str], list[int]]:
    """The gram that starts at each code point, and the place it ends before;
    a gram that only the end of the word stops ends one place further (what
    is appended could touch it)."""
    n = len(word)
    grams, ends = [], []
    for i in range(n - QMIN + 1):
        q = QMIN
        while q < QMAX and i + q <= n and word[i:i + q] in frequent:
            q += 1
        grams.append(word[i:i + q])
        ends.append(i + q)
    return grams, ends


def postings_of(word: str, frequent: set[str]) -> list[tuple[int, bool, str]]:
    """(place, whether a gap, what the grams that an edit there leaves untouched
    spell before and after it) for every place and gap of the word.  Grams start
    everywhere, so those on one side overlap and spell one piece of the word;
    where too little is left for a gram, its length stands for it."""
    _, ends = decompose(word, frequent)
    by_end: dict[int, int] = {}
    for i, e in enumerate(ends):
        by_end.setdefault(e, i)
    n, out, first, to = len(word), [], len(word), 0
    for p in range(n + 1):
        if p in by_end:
            first, to = min(first, by_end[p]), p
        left = f"{first}{word[first:to]}|" if to else "|"
        if n - p >= QMIN:
            out.append((p, True, left + word[p:]))
        else:
            out.append((p, True, f"{left}{n - p}"))
        if n - p > QMIN:
            out.append((p, False, left + word[p + 1:]))
        elif p < n:
            out.append((p, False, f"{left}{n - p - 1}"))
    return out


def postings(words: DataFrame, frequent: set[str]) -> DataFrame:
    """``k, p, gap, word, n``: every word under the digests of its untouched grams."""
    import xxhash
    known = words.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                keys, places, gaps, of = [], [], [], []
                for j, w in enumerate(b.column("word").to_pylist()):
                    for p, gap, said in postings_of(w, known.value):
                        keys.append(xxhash.xxh3_64_intdigest(said.encode(), p) - (1 << 63))
                        places.append(p)
                        gaps.append(gap)
                        of.append(j)
                of = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(places, pa.int32()), pa.array(gaps, pa.bool_()),
                     b.column("word").take(of), b.column("n").take(of)], names=["k", "p", "gap", "word", "n"])

    return map_arrow(words, run, "k long, p int, gap boolean, word string, n long")


def near_pairs(words: DataFrame, rare: int = RARE) -> DataFrame:
    """``word, other, other_n``: both directions of every two of the distinct
    words (``word, n``, pinned) that differ by exactly one inserted, deleted or
    replaced code point, each once."""
    # few rows make many postings: spread them over all tasks first
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = pin(postings(words.repartition(tasks, "word"), frequent_grams(words, rare)))
    held = posts.filter("not gap").select("k", F.col("p").alias("bp"), F.col("word").alias("b"), F.col("n").alias("bn"))
    met = posts.withColumnsRenamed({"word": "a", "n": "an"}).join(held, "k")
    a_rest = F.when(F.col("gap"), F.expr("substring(a, p + 1)")).otherwise(F.expr("substring(a, p + 2)"))
    same = met.filter((F.expr("p = bp and left(a, p) = left(b, p)")) & (a_rest == F.expr("substring(b, p + 2)"))
                      & (F.expr("substring(a, p + 1, 1) != substring(b, p + 1, 1)")))
    ways = F.when(F.col("gap"), F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n")),
                                        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("other_n")))
                  ).otherwise(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("other_n"))))
    return same.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from pinned ``word, form``: the last word reached over
    forms.  A form is far more frequent than its word, so there are no circles
    and paths are short; each round doubles the step."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        moved = pin(now.join(step, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        now = moved.select("word", "root")
        if moved.filter("_moved").isEmpty():
            return now


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 7,
                      min_count: int = 2, times: int = 10, typo_every: int | None = None, rare: int = RARE) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``n_near`` counts the words one edit away; ``form`` is the most frequent
    of them (ties: the smallest in code-point order) if at least ``times`` as
    frequent as the word; ``root`` is the last word reached over forms, the word
    itself without any.  ``typo_every`` leaves a letter out of a known part
    of the words first: where it divides h, the CRC-32 of ``<id>:<word>``, code
    point h % length (for trials)."""
    if min_length < QMIN + QMAX + 1:
        raise ValueError(f"min_length must be at least {QMIN + QMAX + 1}: shorter words keep no gram beside an edit")
    words = pin(word_counts(df, id_col, text_col, min_length, min_count, typo_every))
    none = F.lit(None)
    rows = words.select("word", "n", none.cast("string").alias("other"), none.cast("long").alias("other_n")).unionByName(
        near_pairs(words, rare).select("word", none.cast("long").alias("n"), "other", "other_n"))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))))
    seen = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("_best"))
    has = F.coalesce(-F.col("_best.m") >= times * F.col("n"), F.lit(False))
    formed = pin(seen.select("word", "n", "n_near", F.when(has, F.col("_best.w")).alias("form"),
                             F.when(has, -F.col("_best.m")).alias("form_n")))
    last = roots(formed.filter("form is not null").select("word", "form")).withColumnRenamed("word", "_w")
    return formed.join(last, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
