"""Forward selection by test AUC with all candidates of a step in one job.

The rows are pinned once as dense blocks.  A *logistic* step fits every candidate at
the same time by Newton's method: one job sums the gradients and normal equations of
all candidates' models over the blocks, the driver solves the small systems, and
candidates that have converged drop out.  Fits start from the chosen features'
last coefficients.  A *naive Bayes* step needs no fit at all: the class means and variances of
every feature come from one pass, and a model's log odds are a sum over its
features.

The AUCs of a step, of all candidates and both sets, are one further job: scores are counted
in each task, cut into ranges by quantiles of a bounded sample, sent as packed arrays, and summed
within their range; what crosses ranges is a few numbers each.  They are exact (ties
count half) wherever the ranges fall.

What reaches the driver is bounded by the number of features and ranges: sums
of (features + 2) squared numbers for each candidate, merged to at most ``MERGE`` parts first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: rows of a block, rows of the sample that places score ranges, score ranges, parts merged by the driver
BLOCK, SAMPLE, RANGES, MERGE = 4_096, 4_096, 64, 64
#: rows whose scores a task counts together before they travel
CHUNK = 65_536
#: Newton steps at most; mean squared change of the scores (weighed by the curve's slope) at which
#: a fit ends; ridge per row (against collinear columns)
STEPS, CLOSE, RIDGE = 100, 1e-18, 1e-10


def _blocks(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """``n, test, x`` (rows by columns, then the label; doubles, packed) for both sets; nulls count as 0."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    y = F.col(label).cast("double").alias("y")
    both = train.select(*cols, y, F.lit(False).alias("t")).unionByName(test.select(*cols, y, F.lit(True).alias("t"))).filter("y is not null")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)]) if b.num_rows else None
            t = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            for side in (False, True):
                some = x[t == side] if b.num_rows else np.empty((0, 0))
                parts = [some[i:i + BLOCK] for i in range(0, len(some), BLOCK)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(p) for p in parts], pa.int32()), pa.array([side] * len(parts), pa.bool_()),
                     pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())], names=["n", "test", "x"])

    return cut_lineage(both.mapInArrow(packed, "n int, test boolean, x binary"))


def _rows(block) -> np.ndarray:
    """Columns and label of one packed block."""
    x = np.frombuffer(block["x"], dtype=np.float64)
    return x.reshape(block["n"], -1)


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``of(rows)``, a vector of ``size``, over all blocks: a vector per task,
    merged to at most ``MERGE`` before they reach the driver."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for block in b.to_pylist():
                total += of(_rows(block))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    return merged_sum(blocks.mapInArrow(partial, "s binary"), size)


def merged_sum(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the vectors of ``size`` doubles packed in the rows' ``s``."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for s in b.column("s").to_pylist():
                total += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    if parts.rdd.getNumPartitions() > MERGE:
        parts = parts.repartition(MERGE).mapInArrow(merged, "s binary")
    return sum((np.frombuffer(bytes(r.s)) for r in parts.collect()), np.zeros(size))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_all(blocks: DataFrame, sets: list[list[int]], start: list[np.ndarray], mean: np.ndarray, std: np.ndarray, n: float) -> list[np.ndarray]:
    """Logistic coefficients (of standardised columns, then the intercept) of the model
    on each set of columns, all of one size, by Newton steps over the training blocks."""
    p = len(sets[0]) + 1
    coef = [c.copy() for c in start]
    open_ = list(range(len(sets)))
    train = blocks.filter("not test")
    for _ in range(STEPS):
        if not open_:
            break
        now = [(sets[i], coef[i]) for i in open_]

        def sums(rows: np.ndarray, now=now) -> np.ndarray:
            z, y, out = (rows[:, :-1] - mean) / std, rows[:, -1], []
            for cols, w in now:
                x = np.column_stack([z[:, cols], np.ones(len(z))])
                q = _sigmoid(x @ w)
                out += [x.T @ (y - q), ((x * (q * (1 - q))[:, None]).T @ x).ravel()]
            return np.concatenate(out)

        total = _summed(train, sums, len(now) * (p + p * p)).reshape(len(now), -1)
        left = []
        for i, t in zip(open_, total, strict=True):
            ridge = np.full(p, RIDGE * n)
            ridge[-1] = 0
            bend, slope = t[p:].reshape(p, p) + np.diag(ridge), t[:p] - ridge * coef[i]
            step = np.linalg.lstsq(bend, slope, rcond=1e-13)[0]
            change = float(step @ bend @ step)
            step *= min(1.0, 5 / max(np.abs(step).max(), 1e-300))
            coef[i] = coef[i] + step
            if change > CLOSE * n:
                left.append(i)
        open_ = left
    return coef


def _counted(s: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct scores in order, with the sums of both counts (NaN is one score, the greatest)."""
    order = np.argsort(s, kind="stable")
    s = s[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) & ~np.isnan(s[:-1])])
    return s[first], np.add.reduceat(pos[order], first), np.add.reduceat(neg[order], first)


def auc_all(blocks: DataFrame, score: Callable[[np.ndarray], np.ndarray], m: int, sample: np.ndarray) -> np.ndarray:
    """(m, 2): AUC on the training and the test rows of each of ``m`` scores (columns of
    ``score(rows)``), NaN where a set has one class only; one job.  Scores travel packed:
    a row for the counted scores of some ``CHUNK`` rows in one range."""
    cuts = np.quantile(score(sample), np.linspace(0, 1, RANGES + 1)[1:-1], axis=0) if len(sample) else np.zeros((1, m))

    def packed(scores: np.ndarray, y: np.ndarray, test: bool) -> pa.RecordBatch:
        out = []
        for g in range(m):
            value, pos, neg = _counted(scores[:, g], y, 1 - y)
            ends = np.r_[np.searchsorted(value, cuts[:, g], side="right"), len(value)]
            start = 0
            for part, end in enumerate(ends):
                if end > start:
                    out.append((g, test, part, *(v[start:end].tobytes() for v in (value, pos, neg))))
                    start = end
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["g", "test", "part", "s", "pos", "neg"]
    kinds = [pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {False: [], True: []}
        for b in batches:
            for i in range(b.num_rows):
                block = {"n": b.column("n")[i].as_py(), "x": b.column("x")[i].as_buffer()}
                test, rows = b.column("test")[i].as_py(), _rows(block)
                held[test].append((score(rows), rows[:, -1].copy()))
                if sum(len(y) for _, y in held[test]) >= CHUNK:
                    yield packed(*(np.concatenate(v) for v in zip(*held[test], strict=True)), test)
                    held[test] = []
        for test, left in held.items():
            if sum(len(y) for _, y in left):
                yield packed(*(np.concatenate(v) for v in zip(*left, strict=True)), test)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their range: the sums of each."""
        def done(parts: list) -> tuple:
            _, pos, neg = _counted(*(np.concatenate([np.frombuffer(p[j]) for p in parts]) for j in range(3)))
            return pos.sum(), neg.sum(), (pos * (np.cumsum(neg) - neg / 2)).sum()
        at, parts, out = None, [], []
        for b in batches:
            for g, test, part, *arrays in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at is not None and at != (g, test, part):
                    out.append((*at, *done(parts)))
                    parts = []
                at = (g, test, part)
                parts.append(arrays)
        if parts:
            out.append((*at, *done(parts)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*kinds[:3], *[pa.float64()] * 3], strict=True)],
                                             names=["g", "test", "part", "pos", "neg", "in"])

    key = ["g", "test", "part"]
    long = blocks.mapInArrow(cut, "g int, test boolean, part int, s binary, pos binary, neg binary")
    got = long.repartition(*key).sortWithinPartitions(*key).mapInArrow(
        summed, "g int, test boolean, part int, pos double, neg double, in double").toArrow()
    out = np.full((m, 2), np.nan)
    t = {c: got.column(c).to_numpy() for c in ("g", "test", "part", "pos", "neg", "in")}
    for g in range(m):
        for side in (0, 1):
            at = np.flatnonzero((t["g"] == g) & (t["test"] == bool(side)))
            at = at[np.argsort(t["part"][at])]
            pos, neg = t["pos"][at], t["neg"][at]
            if pos.sum() and neg.sum():
                before = np.cumsum(neg) - neg
                out[g, side] = (t["in"][at] + pos * before).sum() / (pos.sum() * neg.sum())
    return out


def _select(spark, candidates: Sequence[str], steps: int, aucs: Callable[[list[int], list[int]], np.ndarray]) -> DataFrame:
    """The log of a forward selection; ``aucs(chosen, rest)`` gives (train, test) of each."""
    chosen: list[int] = []
    log = []
    for step in range(1, steps + 1):
        rest = [i for i in range(len(candidates)) if i not in chosen]
        got = aucs(chosen, rest)
        best = int(np.argmax(np.where(np.isnan(got[:, 1]), -1.0, got[:, 1])))
        chosen.append(rest[best])
        train, test = (None if np.isnan(v) else float(v) for v in got[best])
        log.append((step, candidates[rest[best]], ",".join(candidates[i] for i in chosen), train, test))
    return spark.createDataFrame(log, "step int, added string, features string, auc_train double, auc_test double")


def _prepared(train: DataFrame, test: DataFrame, candidates: Sequence[str], label: str):
    """Blocks, a bounded sample of their rows, and per class the count, sums and sums of squares of every column."""
    blocks = _blocks(train, test, candidates, label)
    some = blocks.select("n", F.substring("x", 1, 8 * (len(candidates) + 1) * 64).alias("x"), F.xxhash64("x").alias("h")).orderBy("h", "n").limit(SAMPLE // 64)
    sample = [np.frombuffer(bytes(r.x)).reshape(-1, len(candidates) + 1) for r in some.collect()]
    k = len(candidates)

    def moments(rows: np.ndarray) -> np.ndarray:
        x, y, out = rows[:, :-1], rows[:, -1], []
        for c in (0, 1):
            some = x[y == c]
            out += [[len(some)], some.sum(axis=0), (some ** 2).sum(axis=0)]
        return np.concatenate(out)

    t = _summed(blocks.filter("not test"), moments, 2 * (1 + 2 * k)).reshape(2, -1)
    return blocks, np.concatenate(sample) if sample else np.empty((0, k + 1)), t[:, 0], t[:, 1:1 + k], t[:, 1 + k:]


def stepwise_logistic(train: DataFrame, test: DataFrame, candidates: Sequence[str], max_steps: int | None = None,
                      label: str = "label") -> DataFrame:
    """``step, added, features, auc_train, auc_test``: the unused feature whose logistic
    model with those chosen has the best test AUC, step by step; of equal ones the first
    in the candidates' order.  Nulls count as 0; rows without a label are left out."""
    blocks, sample, n, s, q = _prepared(train, test, candidates, label)
    total = max(n.sum(), 1.0)
    mean = s.sum(axis=0) / total
    std = np.sqrt(np.maximum(q.sum(axis=0) / total - mean ** 2, 0))
    std = np.where(std > 1e-12 * np.maximum(1, np.abs(mean)), std, 1.0)
    odds = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
    last = {"coef": np.array([odds])}
    one_class = not n.min()

    def aucs(chosen: list[int], rest: list[int]) -> np.ndarray:
        sets = [[*chosen, c] for c in rest]
        start = [np.r_[last["coef"][:-1], 0.0, last["coef"][-1]] for _ in rest]
        coef = start if one_class else fit_all(blocks, sets, start, mean, std, total)
        # scores rounded as far as fits agree, so that rows alike in all features tie
        score = lambda rows: np.round(np.column_stack([
            ((rows[:, :-1] - mean) / std)[:, cols] @ w[:-1] + w[-1] for cols, w in zip(sets, coef, strict=True)]), 9)
        got = auc_all(blocks, score, len(rest), sample)
        last["coef"] = coef[int(np.argmax(np.where(np.isnan(got[:, 1]), -1.0, got[:, 1])))]
        return got

    return _select(train.sparkSession, candidates, min(max_steps or len(candidates), len(candidates)), aucs)


def stepwise_naive_bayes(train: DataFrame, test: DataFrame, candidates: Sequence[str], max_steps: int | None = None,
                         label: str = "label", smoothing: float = 1e-9) -> DataFrame:
    """The same selection with Gaussian naive Bayes; ``smoothing`` times the greatest
    variance is added to every variance of a model's features."""
    blocks, sample, n, s, q = _prepared(train, test, candidates, label)
    n = np.maximum(n, 1)[:, None]
    mean = s / n
    var = np.maximum(q / n - mean ** 2, 0)
    overall = np.maximum(q.sum(axis=0) / n.sum() - (s.sum(axis=0) / n.sum()) ** 2, 0)
    odds = float(np.log(n[1, 0] / n[0, 0]))

    def aucs(chosen: list[int], rest: list[int]) -> np.ndarray:
        added = {c: max(smoothing * overall[[*chosen, c]].max(), 1e-300) for c in rest}

        def score(rows: np.ndarray) -> np.ndarray:
            def side(k: int, cols: list[int], extra: float) -> np.ndarray:
                v = var[k, cols] + extra
                return -0.5 * (np.log(v) + (rows[:, cols] - mean[k, cols]) ** 2 / v).sum(axis=1)
            # the chosen features' part once for each smoothing, not for each candidate
            part = {e: [side(k, chosen, e) for k in (0, 1)] for e in set(added.values())}
            return np.round(np.column_stack([
                odds + (part[e][1] + side(1, [c], e)) - (part[e][0] + side(0, [c], e)) for c, e in added.items()]), 9)
        return auc_all(blocks, score, len(rest), sample)

    return _select(train.sparkSession, candidates, min(max_steps or len(candidates), len(candidates)), aucs)
