"""Toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

*Kernel.*  Two strings are alike as far as they share subsequences of four
characters, which need not be adjacent: an occurrence that spans s characters
counts ``DECAY ** s``, up to ``SPAN``.  Gapped and inserted characters
(``id-iot``, ``stuxpid``, ``moxroxn``) therefore lower the likeness a little
instead of destroying it.  Values are scaled by the strings' own lengths.

*Instances.*  The sentences of a labelled document carry its label and are the
training instances.  A sentence is toxic if one of its windows (words; long ones
in overlapping pieces) is, so it is represented by the windows that witness it
(multiple-instance learning), and every window of a clean sentence counts
against.  Words written with separators, look-alike digits or spaced-out letters
are read in their plain form too.  The first witnesses are found from the labels
alone: beginnings of windows, then pieces from within those that no beginning
explains, whose presence goes with the label beyond chance.  After a fit each
toxic sentence is represented by its worst window, and the fit is repeated.

*Spoilt copies.*  Every pure witness is also learnt with one to three letters put
in, together with the same weight as the word itself, so that the fitted function,
not only the kernel, tolerates insertions.  Clean windows that come out too high
are added and the fit is repeated.

*Nystroem.*  Landmarks are windows chosen far apart from each other among the
witnesses, their spoilt copies, clean windows and those that come out too high.
Each window is mapped through its kernel values with the landmarks and a
squared-hinge SVM is fitted there.  As the kernel is an inner product of
subsequence counts, the fitted function is, exactly, one weight per subsequence;
a task holds just this table, and scores each distinct token it meets once.

A document is scored by Platt's logistic curve over its worst windows' decisions,
the number of its tokens on the toxic side and its length, fitted on the training
documents and on copies of the toxic ones with their pure witnesses spoilt.

Fitting looks at a bounded sample of labelled rows (about ``MAX_ROWS``
documents, chosen by hash); scoring reads every whole text.  No label, language, source or id
enters a score.

Defined results: null text counts as empty; an empty text scores like one
whose words resemble no landmark; without labelled rows of both kinds, or
without witnesses, every score is the share of toxic rows (0 if none); labels
other than 0 and 1 are left out; of repeated label rows the largest counts;
repeated documents are scored each, and learnt from once (the smallest text of an id); an empty table gives an empty result;
other columns take no part.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, pin, release_memory, whole_text

#: weight of a character spanned, most characters spanned, characters of a subsequence
DECAY, SPAN, LENGTH = 0.8, 8, 4
#: longest word handled as one; longer ones are read in overlapping windows
WORD, STEP = 32, 16
#: bounds of the training sample: labelled documents; clean windows at first, and those added after each fit
MAX_ROWS, NEGATIVES, HARD = 20_000, 6_000, 8_000
#: landmarks taken from witnesses of each kind, witnesses, spoilt copies, clean windows, windows that came out too high
LANDMARKS = (64, 64, 96, 64, 192)
#: spoilt copies of each pure witness, fits
SPOILT, ROUNDS = 16, 4
#: times by which a witness must raise the odds of the toxic side (whatever their share)
ODDS = 4
#: marks of a window's ends; sizes of the beginnings looked at (with the mark: whole
#: words of two letters up), and of the pieces from within
BEGIN, END = "\x02", "\x03"
BEGINNINGS, INNER = (4, 5, 6, 7, 8, 9), (5, 6, 7, 8)
#: distinct words remembered per Python worker; beyond it the memory starts anew
REMEMBER = 120_000
#: documents read, and words mapped, at a time
DOCS_AT_ONCE, WORDS_AT_ONCE = 128, 2_000
#: pairs of equal subsequences that the kernel looks at, at a time
PAIRS_AT_ONCE = 1 << 18
#: digits and signs read as the letters they look like (fixed values)
LOOKALIKE = str.maketrans("013457@$!", "oieastasi")
EDGE = " \t\n\r\f\v.,;:!?\"'()[]{}<>«»„“”‘’*#$%&|/\\-_=+~^`…–—"
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: numbers a document's words are reduced to, see ToxicityModel.evidence
EVIDENCE = 5


def forms(token: str) -> list[str]:
    """Readings of a lower-cased token: without its outer marks, without the
    marks inside, with look-alikes as letters; long ones as windows."""
    t = token.strip(EDGE) or token[:1]
    out = [t]
    if t.isalpha():
        if len(t) <= WORD:
            return out
    else:
        plain = "".join(c for c in t if c.isalnum())
        if any(c.isalpha() for c in t):
            out += [plain, "".join(c for c in t.translate(LOOKALIKE) if c.isalpha())]
    cut = []
    for f in dict.fromkeys(x for x in out if x):
        cut += [f] if len(f) <= WORD else [f[i:i + WORD] for i in range(0, len(f) - STEP, STEP)]
    return cut


def tokens(text: str) -> set[str]:
    """Distinct tokens, and words spelt with spaces between the letters."""
    low = text.lower()
    found = set(low.split())
    if len(found) and (spelt := SPACED.findall(low)):
        found.update("".join(s.split()) for s in spelt)
    return found


def windows(text: str) -> set[str]:
    """Distinct windows of a text: every reading of its tokens."""
    return {f for t in tokens(text) for f in forms(t)}


def sentences(text: str) -> list[str]:
    return [x for x in SENTENCE.split(text) if x and not x.isspace()]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index, subsequence key, weight) of every gapped occurrence in the
    words (with marks for their ends), weights scaled to length one per word."""
    idx, keys, weights = [], [], []
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(-(-(len(w) + 2) // 4) * 4, []).append(i)
    for size, members in by_size.items():
        at = np.array(members)
        marked = [BEGIN + words[i][:WORD] + END for i in members]
        codes = np.array(marked, dtype=f"U{size}").view(np.uint32).reshape(len(members), size).astype(np.int64) & 0xFFFF
        for j in range(LENGTH - 1, min(SPAN, size)):
            rows, cols = np.nonzero(codes[:, j:] > 0)
            ends = codes[rows, cols] << 16 * (LENGTH - 1) | codes[rows, cols + j]
            inner = [codes[rows, cols + i] for i in range(1, j)]
            for mid in itertools.combinations(range(j - 1), LENGTH - 2):
                key = ends
                for k, i in enumerate(mid):
                    key = key | inner[i] << 16 * (LENGTH - 2 - k)
                keys.append(key)
                idx.append(at[rows])
                weights.append(np.full(len(rows), DECAY ** (j + 1)))
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    idx, keys, weights = np.concatenate(idx), np.concatenate(keys), np.concatenate(weights)
    return idx, keys, weights / lengths(words)[idx]


def lengths(words: list[str]) -> np.ndarray:
    """Lengths of the words' vectors of occurrences: they depend on the words' sizes alone."""
    sizes = np.fromiter((min(len(w), WORD) + 2 for w in words), dtype=np.int64, count=len(words))
    span = np.arange(LENGTH - 1, SPAN)
    ways = np.array([math.comb(int(j) - 1, LENGTH - 2) * DECAY ** (2 * (j + 1)) for j in span])
    return np.sqrt(np.maximum((np.maximum(np.arange(WORD + 3)[:, None] - span, 0) @ ways)[sizes], 1e-300))


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of all words of ``a`` with all of ``b`` (a bounded list)."""
    out = np.zeros((len(a), len(b)))
    for at, part in kernel_parts(a, b):
        out[at:at + len(part)] = part
    return out


def kernel_parts(a: list[str], b: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of :func:`kernel`, some at a time, with the number of the first."""
    bi, bk, bw = subsequences(b)
    order = np.argsort(bk, kind="stable")
    bi, bk, bw = bi[order], bk[order], bw[order]
    for at in range(0, len(a), 500):
        some = a[at:at + 500]
        ai, ak, aw = subsequences(some)
        lo = np.searchsorted(bk, ak, "left")
        n = np.searchsorted(bk, ak, "right") - lo
        part = np.zeros(len(some) * len(b))
        full = np.flatnonzero(n)
        for hit in np.split(full, np.flatnonzero(np.diff(np.cumsum(n[full]) // PAIRS_AT_ONCE)) + 1):
            rep = np.repeat(hit, n[hit])
            other = np.repeat(lo[hit], n[hit]) + np.arange(len(rep)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
            part += np.bincount(ai[rep] * len(b) + bi[other], aw[rep] * bw[other], minlength=len(part))
        yield at, part.reshape(len(some), len(b))


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 30,
                  rows: np.ndarray | None = None) -> np.ndarray:
    """Weights (last: intercept) of a linear SVM with squared hinge loss, by Newton steps.
    ``rows``: the row of ``x`` of each instance, where one stands for several (default: each its own)."""
    rows = np.arange(len(x)) if rows is None else rows
    w = np.zeros(x.shape[1] + 1)
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    for _ in range(rounds):
        gap = 1 - y * ((x @ w[:-1])[rows] + w[-1])
        on = np.flatnonzero(gap > 0)
        grad, bend = ridge @ w, ridge.copy()
        for i in range(0, len(on), 2048):
            at = on[i:i + 2048]
            xo, so = np.ones((len(at), len(w))), 2 * c * weight[at]
            xo[:, :-1] = x[rows[at]]
            grad -= xo.T @ (so * y[at] * gap[at])
            bend += (xo * so[:, None]).T @ xo
        step = np.linalg.solve(bend, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of the logistic curve through document evidence and
    labels (Platt's smoothed targets, a slight ridge, Newton steps)."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1e-1] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((pos + 1) / (neg + 1))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-12)
        s = np.linalg.solve((x * v[:, None]).T @ x + ridge, x.T @ (t - p) - ridge @ w)
        w += min(1.0, 5 / max(np.abs(s).max(), 1e-12)) * s
        if np.abs(s).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    """One weight per subsequence (sorted keys), intercept, calibration."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    slopes: np.ndarray = field(default_factory=lambda: np.zeros(EVIDENCE))
    offset: float = -30.0
    landmarks: list[str] = field(default_factory=list)

    def _tables(self) -> list[tuple[np.uint64, int, np.ndarray, np.ndarray]]:
        """The weights as hash tables: what collides in one goes to the next."""
        if "_hashed" not in self.__dict__:
            self._hashed, left, k = [], np.arange(len(self.keys)), 0
            while len(left):
                k += 1
                bits = max(8, int(2 * len(left)).bit_length())
                mixer = np.uint64(0x9E3779B97F4A7C15 + 2 * k)
                slot = (self.keys[left].astype(np.uint64) * mixer >> np.uint64(64 - bits)).astype(np.int64)
                _, first = np.unique(slot, return_index=True)
                held, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
                held[slot[first]], value[slot[first]] = self.keys[left[first]], self.weights[left[first]]
                self._hashed.append((mixer, bits, held, value))
                left = np.delete(left, first)
        return self._hashed

    def _direct(self) -> tuple[np.ndarray, int, np.ndarray] | None:
        """The weights as one table addressed by the characters' numbers among those of
        the landmarks; None for an alphabet of over 63."""
        if "_table" not in self.__dict__:
            self._table = None
            letters = np.unique(np.concatenate([self.keys >> 16 * i & 0xFFFF for i in range(LENGTH)]))
            letters = letters[letters > 0]
            if len(letters) <= 63:
                base = len(letters) + 1
                number = np.zeros(1 << 16, np.int32)
                number[letters] = np.arange(1, base)
                at = sum(number[self.keys >> 16 * i & 0xFFFF].astype(np.int64) * base ** i for i in range(LENGTH))
                weights = np.zeros(base ** LENGTH, np.float32)
                weights[at] = self.weights
                self._table = number, base, weights
        return self._table

    def decide(self, words: list[str]) -> np.ndarray:
        """SVM decision of each word."""
        if not len(self.keys) or not words:
            return np.full(len(words), self.intercept)
        if self._direct() is None:
            return self._decide_hashed(words)
        number, base, weights = self._direct()
        found = np.zeros(len(words))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(min(len(w), WORD) + 2, []).append(i)
        for size, members in by_size.items():
            marked = [BEGIN + words[i][:WORD] + END for i in members]
            codes = number[np.array(marked, dtype=f"U{size}").view(np.uint32).reshape(len(members), size).T & 0xFFFF]
            shifted = [codes * np.int32(base ** i) for i in range(LENGTH)]          # by their place from the end of a subsequence
            total = np.zeros(len(members))
            for j in range(LENGTH - 1, min(SPAN, size)):
                n, ends = size - j, shifted[-1][:size - j] + shifted[0][j:]
                part = np.zeros((n, len(members)), np.float32)
                for mid in itertools.combinations(range(1, j), LENGTH - 2):
                    key = ends
                    for k, i in enumerate(mid):
                        key = key + shifted[LENGTH - 2 - k][i:i + n]
                    part += weights[key]
                total += part.sum(axis=0) * DECAY ** (j + 1)
            found[members] = total
        return found / lengths(words) + self.intercept

    def _decide_hashed(self, words: list[str]) -> np.ndarray:
        idx, keys, w = subsequences(words)
        found = np.zeros(len(words))
        for mixer, bits, held, value in self._tables():
            slot = (keys.astype(np.uint64) * mixer >> np.uint64(64 - bits)).astype(np.int64)
            hit = held[slot] == keys
            at = np.flatnonzero(hit)
            found += np.bincount(idx[at], value[slot[at]] * w[at], minlength=len(words))
            rest = np.flatnonzero(~hit & (held[slot] >= 0))       # only these can be in a later table
            idx, keys, w = idx[rest], keys[rest], w[rest]
        return found + self.intercept

    def read(self, texts: list[str], memory: dict[str, float], plain: bool = False) -> list[tuple[list[float], str]]:
        """Evidence of each text and its worst token (its worst window, if
        ``plain``); ``memory`` keeps the decisions."""
        found = [windows(t) if plain else tokens(t) for t in texts]
        if len(memory) > REMEMBER:
            memory.clear()
        new = set().union(*found) - memory.keys() if found else set()
        if new:
            new = list(new)
            many = [[t] if plain else forms(t) for t in new]
            flat = [f for m in many for f in m]
            d = np.concatenate([np.zeros(0), *(self.decide(flat[i:i + WORDS_AT_ONCE]) for i in range(0, len(flat), WORDS_AT_ONCE))])
            ends = np.cumsum([len(m) for m in many])
            starts = ends - [len(m) for m in many]
            best = np.maximum.reduceat(d, starts) if len(d) else d
            memory.update(zip(new, best.tolist(), strict=True))
        return [self._evidence(list(f), [memory[t] for t in f]) for f in found]

    def _evidence(self, names: list[str], values: list[float]) -> tuple[list[float], str]:
        """Evidence of a document: its worst and second worst decision, the number
        of tokens on the toxic side and clearly so, the number of all; and the worst."""
        n = len(names)
        worst = max(values, default=0.0)
        top = max((t for t, v in zip(names, values, strict=True) if v == worst), default="")
        d = np.array(values, dtype=float)
        two = np.sort(np.append(np.full(2, self.intercept), np.partition(d, n - 2)[n - 2:] if n > 2 else d))[::-1]
        return [two[0], two[1], math.log1p((d > 0).sum()), math.log1p((d > 0.7).sum()), math.log1p(n)], top

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence.reshape(-1, EVIDENCE) @ self.slopes + self.offset, -500, 500)))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ``DOCS_AT_ONCE`` rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, DOCS_AT_ONCE):
            yield b.slice(i, DOCS_AT_ONCE)


def _window_counts(rows: DataFrame) -> DataFrame:
    """``word, pos, neg, spos, sneg``: labelled documents, and sentences of them, of
    each kind that hold the window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            words, label, held = [], [], []
            for t, y in zip(b.column("_text").to_pylist(), b.column("_y").to_pylist(), strict=True):
                found = Counter(w for x in sentences(t) for w in windows(x))
                found.update(dict.fromkeys(windows(t) - found.keys(), 1))     # spelt across sentences
                words += found.keys()
                held += found.values()
                label += [y] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(label, pa.int32()), pa.array(held, pa.int64())],
                                             names=["word", "_y", "_n"])

    toxic = F.col("_y") == 1
    return (map_arrow(rows.select("_text", "_y"), run, "word string, _y int, _n long").groupBy("word")
            .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"),
                 F.sum(F.when(toxic, F.col("_n")).otherwise(0)).alias("spos"), F.sum(F.when(toxic, 0).otherwise(F.col("_n"))).alias("sneg")))


def _g2(pos, neg, share):
    """Log-likelihood ratio of a count of toxic and clean rows against the share of all."""
    n = pos + neg
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return F.when(pos > n * share, 2 * (part(pos, n * share) + part(neg, n * (1 - share)))).otherwise(0.0)


def _without_copies(rows: DataFrame) -> DataFrame:
    """One row of each set of near copies among the (bounded) training rows, so
    that the words of a copied document don't count as often as it was copied:
    rows that share the smallest hash of their word pairs, by either of two
    hashes, are taken for copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            first, second = [], []
            for t in b.column("_text").to_pylist():
                w = t.lower().split()
                pairs = [f"{x} {y}".encode("utf-8", "surrogatepass") for x, y in zip(w, w[1:], strict=False)] or [t.encode("utf-8", "surrogatepass")]
                first.append(min(map(xxhash.xxh3_64_intdigest, pairs)) >> 1)
                second.append(min(xxhash.xxh3_64_intdigest(x, 1) for x in pairs) >> 1)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                                             names=["_row", "_a", "_b"])

    hashed = map_arrow(rows.select("_row", "_text"), run, "_row long, _a long, _b long")
    once = hashed.groupBy("_a").agg(F.min(F.struct("_row", "_b")).alias("m")).select("m.*")
    stay = pin(once.groupBy("_b").agg(F.min("_row").alias("_row")).select("_row"))
    return pin(rows.join(F.broadcast(stay), "_row"))       # at most the training rows: a proven bound


def witnesses(counts: DataFrame, share: float) -> tuple[list[str], list[str]]:
    """Beginnings of windows, and pieces from within windows that none of these
    begin, that go with the label beyond chance; none contains another."""
    marked = counts.select("pos", "neg", F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("w"))

    def chosen(pieces: DataFrame) -> list[str]:
        table = pin(pieces.groupBy("piece").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter(
            (F.col("pos") >= 3) & (F.col("pos") * (1 - share) > ODDS * share * F.col("neg")))
            .withColumn("g2", _g2(F.col("pos"), F.col("neg"), F.lit(share))))
        floor = 2 * math.log(max(1, table.count())) + 12            # chance of the whole table's largest, with room
        out: list[str] = []
        for r in table.filter(F.col("g2") >= floor).orderBy(F.desc("g2"), F.desc(F.length("piece")), "piece").collect():
            if not any(r.piece in c or c in r.piece for c in out):
                out.append(r.piece)
        return out

    begins = chosen(marked.select("pos", "neg", F.explode(F.array_distinct(F.array(
        *[F.substring("w", 1, k) for k in BEGINNINGS]))).alias("piece")).filter(F.length("piece") >= BEGINNINGS[0]))
    rest = marked.filter(~holds(F.col("w"), begins, [])).select("pos", "neg", F.substring("w", 2, WORD).alias("w"))

    def inner(k: int):
        last = F.length("w") - k + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring("w", i, F.lit(k)))
                      ).otherwise(F.array().cast("array<string>"))
    pieces = F.array_distinct(F.flatten(F.array(*[inner(k) for k in INNER])))
    return begins, chosen(rest.select("pos", "neg", F.explode(pieces).alias("piece")))


def holds(marked, begins: list[str], inner: list[str]):
    """Whether a marked window begins with one of ``begins`` or has one of ``inner`` in it."""
    out = F.lit(False)
    for k in BEGINNINGS:
        if same := [b for b in begins if len(b) == k]:
            out = out | F.substring(marked, 1, k).isin(same)
    for piece in inner:
        out = out | F.contains(marked, F.lit(piece))
    return out


def spoilt(word: str, rng: np.random.Generator) -> str:
    """The word with one letter to three, by its length, put in between."""
    for _ in range(int(rng.integers(1, 2 + min(2, max(1, (len(word) - 2) // 3))))):
        j = int(rng.integers(1, len(word)))
        word = word[:j] + chr(int(rng.integers(97, 123))) + word[j:]
    return word


def _far_apart(words: list[str], n: int) -> list[str]:
    """Greedy choice of words each least like those chosen before, of at most the first 1,500."""
    words = words[:1_500]
    if len(words) <= n:
        return list(words)
    all_like = kernel(words, words)
    pick, like = [0], all_like[0]
    while len(pick) < n:
        i = int(like.argmin())
        pick.append(i)
        like = np.maximum(like, all_like[i])
    return [words[i] for i in sorted(set(pick))]


def _fit_words(good: list[str], hard: list[str], bad: dict[str, tuple[int, int]], heads: list[str], rng: np.random.Generator) -> ToxicityModel:
    """``bad``: witnesses with the toxic and the clean sentences that hold them, commonest first.
    Each sentence that holds a window counts, on its own side, spoilt copies together
    as much as their word, the clean windows together as much as all these."""
    copies = [(w, spoilt(w, rng)) for w, (_, clean) in bad.items() if not clean and len(w) >= 4 for _ in range(SPOILT)]
    spoiled = [v for _, v in copies]
    one, two, three, four, five = LANDMARKS
    landmarks = sorted({*heads[:one], *_far_apart(list(bad), two), *_far_apart(spoiled, three), *_far_apart(good, four), *_far_apart(hard, five)})
    mm = kernel(landmarks, landmarks)
    values, vectors = np.linalg.eigh((mm + mm.T) / 2)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = [*bad, *spoiled, *good]
    x = np.empty((len(words), root.shape[1]))          # the fit's one large array: neither it nor the kernel values are held twice
    for i, part in kernel_parts(words, landmarks):
        x[i:i + len(part)] = part @ root
    n, m = len(bad), len(spoiled)
    at = np.r_[np.arange(n), np.arange(len(x))]                  # a witness stands on either side
    pos, neg = np.array(list(bad.values()), dtype=float).T
    extra = np.array([bad[w][0] / SPOILT for w, _ in copies])
    weight = np.concatenate([pos, neg, extra, np.full(len(good), (pos.sum() + extra.sum()) / len(good))])
    side = np.r_[np.ones(n), -np.ones(n), np.ones(m), -np.ones(len(good))]
    w = squared_hinge(x, side, weight / weight.sum(), c=2e4, rows=at)
    alpha = root @ w[:-1]
    idx, keys, values = subsequences(landmarks)
    known, inverse = np.unique(keys, return_inverse=True)
    return ToxicityModel(known, np.bincount(inverse, alpha[idx] * values), float(w[-1]), landmarks=landmarks)


def _spoilt_text(text: str, pure: set[str], rng: np.random.Generator) -> str | None:
    """The text with its pure witnesses spoilt; None if it has none."""
    out, found = [], False
    for token in text.split():
        hit = next((f for f in forms(token.lower()) if f in pure), None)
        found |= hit is not None
        out.append(token if hit is None else spoilt(hit, rng))
    return " ".join(out) if found else None


def _pieces(batch: pa.RecordBatch, model: ToxicityModel, memory: dict[str, float], text=lambda b: b.column("_text")):
    """(rows, evidence, worst tokens) for some rows at a time."""
    for part in _few(iter([batch])):
        got = model.read(["" if t is None else str(t) for t in text(part).to_pylist()], memory)
        yield part, np.array([e for e, _ in got]), [t for _, t in got]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 11) -> ToxicityModel:
    """Fit on the labelled rows given (about ``max_rows`` of them at most)."""
    given = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y")))
    given = hash_sample(given, F.col("_id"), max_rows, seed)
    # about max_rows ids: a bound for the broadcast, and, with one text for each id, for all that follows
    rows = pin(docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
               .join(F.broadcast(given), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text"))
               .select("_text", "_y", F.monotonically_increasing_id().alias("_row")))
    rows = _without_copies(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos")).first()
    if not size.n or not size.pos or size.pos == size.n:
        share = (size.pos or 0) / size.n if size.n else 0.0
        return ToxicityModel(offset=math.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0)
    share = size.pos / size.n
    counts = pin(_window_counts(rows))
    mass = counts.agg(F.sum("pos").alias("p"), F.sum(F.col("pos") + F.col("neg")).alias("n")).first()
    begins, inner = witnesses(counts, mass.p / mass.n)
    flat = ToxicityModel(offset=math.log(share / (1 - share)))
    marked = F.concat(F.lit(BEGIN), "word", F.lit(END))
    tells = holds(marked, begins, inner)
    first = counts.filter(tells & (F.col("pos") > 0)).orderBy(F.desc("spos"), "word").collect()   # bounded by the sample
    clean = pin(counts.filter(~tells & (F.col("neg") > 0) & (F.length("word") > 0)))
    good = [r.word for r in clean.orderBy(F.xxhash64("word", F.lit(seed))).limit(NEGATIVES).collect()]
    if not first or not good:
        return flat
    witness = {r.word: (r.spos, r.sneg) for r in first}
    heads = [w for w in (next((w for w in witness if p in BEGIN + w + END), None) for p in [*begins, *inner]) if w]
    bad, hard = witness, []
    rng = np.random.default_rng(seed)
    model = _fit_words(good, hard, bad, heads, rng)
    toxic = rows.filter("_y = 1").select("_text")
    for _ in range(ROUNDS - 1):
        # clean windows that look worst, as further counter-examples
        def decided(batches, model=model):
            for b in batches:
                words = b.column("word").to_pylist()
                d = [model.decide(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
                yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(np.concatenate([np.zeros(0), *d]))], names=["word", "d"])
        worst = map_arrow(clean.select("word"), decided, "word string, d double").orderBy(F.desc("d"), "word").limit(HARD)
        hard = [r.word for r in worst.collect()]
        good = list(dict.fromkeys([*good, *hard]))

        # toxic sentences that the model sees are represented by their worst window
        def represented(batches, model=model):
            memory: dict[str, float] = {}
            for b in _few(batches):
                found = [x for t in b.column("_text").to_pylist() for x in sentences(t)]
                got = [w for e, w in model.read(found, memory, plain=True) if e[0] > 0]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["word"])
        stands = map_arrow(toxic, represented, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        new = stands.join(counts.select("word", "sneg"), "word").collect()    # at most the sample's toxic sentences
        bad = dict(sorted((witness | {r.word: (r.n, r.sneg) for r in new if r.word in witness or not r.sneg}).items(), key=lambda x: (-x[1][0], x[0])))
        release_memory()                    # of the last fit, on the driver
        model = _fit_words([g for g in good if g not in bad], hard, bad, heads, rng)
    release_memory()

    pure = {w for w, (_, n) in bad.items() if not n and len(w) >= 4}

    def gather(batches, model=model):
        memory: dict[str, float] = {}
        for b in batches:
            for part, evidence, _ in _pieces(b, model, memory):
                yield pa.RecordBatch.from_arrays([part.column("_y"), pa.array(list(evidence), pa.list_(pa.float64()))],
                                                 names=["_y", "_e"])
                texts = [(t or "", zlib.crc32((t or "").encode("utf-8", "surrogatepass"))) for t, y in
                         zip(part.column("_text").to_pylist(), part.column("_y").to_pylist(), strict=True) if y == 1]
                more = [x for t, h in texts if (x := _spoilt_text(t, pure, np.random.default_rng([seed, h]))) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(more), pa.int32()), pa.array([e for e, _ in model.read(more, memory)], pa.list_(pa.float64()))],
                                                 names=["_y", "_e"])
    seen = map_arrow(rows.select("_y", "_text"), gather, "_y int, _e array<double>").toArrow()  # at most twice max_rows
    model.slopes, model.offset = calibrate(np.array(seen.column("_e").to_pylist()), seen.column("_y").to_numpy().astype(float))
    return model


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7) -> DataFrame:
    """``id_col, score, predicted, worst`` (the word the score rests on) of every row."""
    src = df.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            for part, evidence, worst in _pieces(b, model, memory):
                p = model.probability(evidence)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(worst, pa.string())],
                    names=["_id", "score", "predicted", "worst"])

    return map_arrow(src, run, f"_id {kind}, score double, predicted int, worst string").withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def reject_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``df``, all columns, that score below the threshold: one pass, no shuffle."""
    cols = df.columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_r"))
    at = cols.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            for part, evidence, _ in _pieces(b, model, memory, lambda p: p.column("_r").field(at)):
                yield part.filter(pa.array(model.probability(evidence) < threshold))

    return map_arrow(packed, run, f"_r {packed.schema['_r'].dataType.simpleString()}").select("_r.*")
