"""Quality by hierarchical empirical Bayes: document, path and host.

*Document evidence.*  A logistic classifier over the shape of the text (shares
of character kinds, word and line statistics, compressibility) gives every
document a probability of good quality.  It is fitted on a bounded sample of
labelled rows (about ``MAX_ROWS``, chosen by hash).

*Sites.*  Probabilities of all documents are summed per host and per path (a
part of a host) by grouped, partial aggregation; the variances of the nested
model (documents within paths, paths within their host, hosts), by the method of
moments, say how many documents the prior is worth at either level.  A host's posterior is its mean shrunk towards the
global one, a path's is its mean shrunk towards its host's posterior: a site
seen once hardly moves, one seen a thousand times speaks for itself.

*Together.*  A document's log odds move by those of its path (itself left out)
against the global ones.  How much a site may say is weighed by ``site_weight``.

Sums and counts cover all documents; one row of totals reaches the driver.  A
host with a third of all rows is one partial row per task, and the join back to
its documents carries ids and numbers only and is split at run time.

Defined results: null and empty texts have the evidence of an empty text; a
null host or path is one of its own; without labelled rows of both kinds the
classifier says the share of good rows (one half without any); repeated rows
count each, but are learnt from once (the smallest text of an id); of repeated label rows the smallest counts; labels other than 0
and 1 are left out; an empty table gives an empty result; other columns take
no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, pin, whole_text

#: labelled rows the classifier is fitted on at most
MAX_ROWS = 20_000
FEATURES = 18
#: least and most documents that a prior is worth
MOST_WORTH = (0.5, 1e6)
#: bytes compressed at a time for the compressibility of a text
BLOCK = 1 << 16


def features(text: str) -> list[float]:
    """Shape of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * FEATURES
    seen = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / n
    upper, lower, digit = seen[65:91].sum(), seen[97:123].sum(), seen[48:58].sum()
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    count = max(1, len(words))
    packed = sum(len(zlib.compress(data[i:i + BLOCK], 1)) for i in range(0, n, BLOCK))
    stops = seen[46] + seen[33] + seen[63]
    return [upper, lower, digit, float(seen[128:].sum()), float(seen[32]), float(seen[10]), float(seen[44]), float(stops),
            float(seen[33]), float(seen[124]), float(seen[[35, 36, 37, 38, 42]].sum()), float(seen[[60, 62, 91, 93, 123, 125, 95, 61]].sum()),
            math.log1p(len(words)), sum(map(len, words)) / count / 10, len(set(words)) / count ** 0.8,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / count,
            len(set(lines)) / max(1, len(lines)), packed / n]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    r = np.diag([ridge * len(x) / 100] * (x.shape[1] - 1) + [1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        v = np.maximum(p * (1 - p), 1e-10)
        s = np.linalg.solve((x * v[:, None]).T @ x + r, x.T @ (y - p) - r @ w)
        w += min(1.0, 5 / max(np.abs(s).max(), 1e-12)) * s
        if np.abs(s).max() < 1e-8:
            break
    return w


def _featured(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``_f``, the features of ``_text``."""
    src = rows.select(*keep, "_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t.as_py()) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(f, pa.list_(pa.float64()))],
                                             names=[*keep, "_f"])

    return map_arrow(src, run, schema + ", _f array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_rows: int = MAX_ROWS, seed: int = 13) -> tuple[list[float], float]:
    """Weights of the (raw) features and offset."""
    given = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y")))
    given = hash_sample(given, F.col("_id"), max_rows, seed)
    # about max_rows ids: a bound for the broadcast, and, with one text for each id, for the rows gathered
    rows = (docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(given), "_id")
            .groupBy("_id", "_y").agg(F.min("_text").alias("_text")))
    got = _featured(rows, ["_y"]).toArrow()
    y = got.column("_y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return [0.0] * FEATURES, math.log(share / (1 - share))
    x = np.array(got.column("_f").to_pylist())
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    w = logistic((x - mean) / std, y)
    return (w[:-1] / std).tolist(), float(w[-1] - (w[:-1] * mean / std).sum())


@dataclass
class Variances:
    """Spread of the evidence: between documents of a path, paths of a host, hosts."""

    within: float
    path: float
    host: float

    def path_strength(self) -> float:
        """Documents that a host's posterior is worth to its paths."""
        return _worth(self.within, self.path)

    def host_strength(self, crowding: Column) -> Column:
        """Documents that the global mean is worth to a host; ``crowding`` is the
        sum of its squared path sizes over its size (documents that share a path
        say less about the host than as many of different paths)."""
        least, most = F.lit(MOST_WORTH[0]), F.lit(MOST_WORTH[1])
        if self.host <= 0:
            return most
        return F.greatest(least, F.least(most, (F.lit(self.within) + self.path * crowding) / self.host))


def _worth(noise: float, spread: float) -> float:
    return min(max(noise / spread, MOST_WORTH[0]), MOST_WORTH[1]) if spread > 0 else MOST_WORTH[1]


def variances(hosts: DataFrame) -> Variances:
    """Of the nested model document = mean + host + path + noise, by the method of
    moments (one row of totals).  ``hosts`` has ``n, s, q`` (count, sum and sum of
    squares of the evidence), ``paths``, ``b`` (sum over paths of s*s/n) and
    ``nn`` (sum over paths of n*n).

    Paths are measured around their own host, hosts around the global mean less what
    paths and noise put there.  A level whose sum of squares is within three standard
    errors of what the levels below explain has no variance."""
    each = F.col("nn") / F.col("n")
    t = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("paths").alias("p"), F.sum("n").alias("n"), F.sum("s").alias("s"),
                  F.sum("q").alias("q"), F.sum("b").alias("b"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("a"),
                  F.sum("nn").alias("nn"), F.sum(each).alias("each"), F.sum(F.col("n") * F.col("n")).alias("hh")).first()
    if not t.n or t.n <= t.p:
        return Variances(1e-9, 0.0, 0.0)
    within = max((t.q - t.b) / (t.n - t.p), 1e-9)

    def level(squares: float, free: float, below: float, share: float) -> float:
        over = squares - below
        return over / share if free > 0 and share > 0 and over > 3 * below * math.sqrt(2 / free) else 0.0

    path = level(t.b - t.a, t.p - t.h, (t.p - t.h) * within, t.n - t.each)
    host = level(t.a - t.s * t.s / t.n, t.h - 1, (t.h - 1) * within + path * (t.each - t.nn / t.n), t.n - t.hh / t.n)
    return Variances(within, path, host)


def score(df: DataFrame, model: tuple[list[float], float], host: Column, path: Column, id_col: str = "doc_id",
          text_col: str = "text", threshold: float = 0.5, site_weight: float = 1.0) -> DataFrame:
    """``id_col, evidence, host_posterior, path_posterior, score, keep`` of every row."""
    weights, offset = model
    rows = df.select(F.col(id_col).alias("_id"), host.cast("string").alias("_host"), path.cast("string").alias("_path"),
                     whole_text(text_col).alias("_text"))
    dot = F.aggregate(F.zip_with("_f", F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(offset), lambda a, b: a + b)
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), dot))))
    docs = pin(_featured(rows, ["_id", "_host", "_path"]).select("_id", "_host", "_path", p.alias("_p")))

    paths = pin(docs.groupBy("_host", "_path").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q")))
    n, s = F.col("n"), F.col("s")
    hosts = pin(paths.groupBy("_host").agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"),
                                           F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn")))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = float(np.clip(total.s / total.n, 1e-6, 1 - 1e-6)) if total.n else 0.5
    spread = variances(hosts)
    k_path, k_host = F.lit(spread.path_strength()), F.col("kh")

    def shrunk(s: Column, n: Column, to: Column, k: Column) -> Column:
        return (s + k * to) / (n + k)

    sites = pin(paths.alias("p").join(hosts.alias("h"), F.col("p._host").eqNullSafe(F.col("h._host"))).select(
        F.col("p._host").alias("_h"), F.col("p._path").alias("_l"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps"),
        F.col("h.n").alias("hn"), F.col("h.s").alias("hs"), spread.host_strength(F.col("h.nn") / F.col("h.n")).alias("kh")))
    met = docs.join(sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_l")))
    own = F.col("_p")
    at_host = shrunk(F.col("hs") - own, F.col("hn") - 1, F.lit(prior), k_host)
    at_path = shrunk(F.col("ps") - own, F.col("pn") - 1, at_host, k_path)
    odds = lambda c: F.log(c / (1 - c))
    safe = lambda c: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), c))
    joined = odds(safe(own)) + site_weight * (odds(safe(at_path)) - math.log(prior / (1 - prior)))
    mark = 1 / (1 + F.exp(-joined))
    return met.select(F.col("_id").alias(id_col), own.alias("evidence"),
                      shrunk(F.col("hs"), F.col("hn"), F.lit(prior), k_host).alias("host_posterior"),
                      at_path.alias("path_posterior"), mark.alias("score"), (mark >= threshold).alias("keep"))
