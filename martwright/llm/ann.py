"""Approximate nearest neighbours over low-dimensional stable projections.

Vectors are projected to a few dimensions by a Gaussian (2-stable) matrix.  A
projected squared distance divided by the true one is chi-square distributed
with as many degrees of freedom as dimensions, so neighbours are taken in the
order of their projected distance from a kd-tree and verified on the original
vectors until the test holds: once the next projected distance is so large
that a point at the present k-th distance would have shown up before with
probability ``confidence``, nothing nearer is expected and the search stops.

On Spark: identical vectors are first reduced to one entry with its smallest
ids (more than k of them can never be listed), so no block is filled by a
repeated vector.  The top of the kd-tree is fitted on a bounded sample and
deals *every* vector to a block of some thousand rows; a block that grows beyond
twice that (the sample bounds the number of blocks) is dealt out in parts, and
each part is searched by a kd-tree of its own.  A query searches the block it lies
in, and then only those other blocks whose projected cell its test still admits.
A task holds one part of a block and at most ``QUERIES`` of the queries that
reach it; a stated query set against all rows, in blocks.

Defined results: vectors that are null, empty, zero, hold nulls or non-finite
numbers, or have another length than ``dim`` (default: the commonest length,
the longer one in a tie) take no part, as query or candidate; rows with a null
id neither; rows repeating id and vector count once; a query lists no row of
its own id; fewer candidates than k give all of them; an empty table or no
queries give an empty result; other columns take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, map_arrow, pin, ship_package

#: rows aimed at in a block, and in a leaf of its kd-tree
BLOCK_ROWS, LEAF_ROWS = 8192, 128
#: rows of the sample the top of the tree is fitted on; queries that a part of a block meets at a time
SAMPLE_ROWS, QUERIES = 50_000, 512


def chi_square_cdf(x: float, dims: int) -> float:
    """Distribution function of the chi-square law, an even number of dimensions."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= half / (i + 1)
    return 1.0 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, dims) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < p else (low, mid)
    return high


def projection(dim: int, dims: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, dims))


class Cells:
    """Top of the kd-tree: median splits of the widest dimension, to a given
    depth; a cell is a box of the projected space and the boxes fill it."""

    def __init__(self, sample: np.ndarray, depth: int, dims: int):
        self.nodes, self.low, self.high = [], [], []
        self._split(sample, depth, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low).reshape(-1, dims), np.array(self.high).reshape(-1, dims)

    def _split(self, pts: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
        """Index of the node; leaves are ~block."""
        if depth == 0 or len(pts) < 2 or not np.ptp(pts, axis=0).max():
            self.low.append(low)
            self.high.append(high)
            return ~(len(self.low) - 1)
        axis = int(np.ptp(pts, axis=0).argmax())
        at = float(np.median(pts[:, axis]))
        left = pts[:, axis] < at
        if not left.any():
            at = float(pts[pts[:, axis] > at, axis].min())
            left = pts[:, axis] < at
        me = len(self.nodes)
        self.nodes.append(None)
        mid_high, mid_low = high.copy(), low.copy()
        mid_high[axis] = mid_low[axis] = at
        self.nodes[me] = (axis, at, self._split(pts[left], depth - 1, low, mid_high),
                          self._split(pts[~left], depth - 1, mid_low, high))
        return me

    def block(self, pts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pts), dtype=np.int64)
        todo = [(0 if self.nodes else ~0, np.arange(len(pts)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                axis, at, left, right = self.nodes[node]
                under = pts[rows, axis] < at
                todo += [(left, rows[under]), (right, rows[~under])]
        return out

    def gap2(self, pt: np.ndarray) -> np.ndarray:
        """Squared distance from a projected point to every cell."""
        return (np.maximum(np.maximum(self.low - pt, pt - self.high), 0.0) ** 2).sum(axis=1)


class BlockTree:
    """kd-tree over the projected points of one block."""

    def __init__(self, vectors: np.ndarray, ids: list, matrix: np.ndarray):
        self.v, self.ids, self.p = vectors, ids, vectors @ matrix
        self.nodes, self.leaves = [], []
        self.root = self._build(np.arange(len(vectors)))

    def _build(self, rows: np.ndarray) -> int:
        p = self.p[rows]
        me = len(self.nodes)
        self.nodes.append(None)
        low, high = p.min(axis=0), p.max(axis=0)
        if len(rows) <= LEAF_ROWS or not (high - low).max():
            self.nodes[me] = (low, high, rows, None, None)
            return me
        axis = int((high - low).argmax())
        order = rows[np.argsort(p[:, axis], kind="stable")]
        half = len(order) // 2
        left, right = self._build(order[:half]), self._build(order[half:])
        self.nodes[me] = (low, high, None, left, right)
        return me

    def search(self, q: np.ndarray, qp: np.ndarray, k: int, stop: float, bound: float) -> list[tuple[float, int]]:
        """The k nearest (distance, id) found; ``bound``: a k-th distance known before."""
        best: list[tuple[float, int]] = []
        kth = bound
        heap = [(0.0, self.root)]
        while heap:
            gap, node = heapq.heappop(heap)
            if gap > stop * kth * kth:
                break
            low, high, rows, left, right = self.nodes[node]
            if rows is None:
                for child in (left, right):
                    clow, chigh = self.nodes[child][:2]
                    away = np.maximum(np.maximum(clow - qp, qp - chigh), 0.0)
                    heapq.heappush(heap, (float(away @ away), child))
                continue
            near = rows[((self.p[rows] - qp) ** 2).sum(axis=1) <= stop * kth * kth] if math.isfinite(kth) else rows
            if not len(near):
                continue
            # running sums: the order of addition of a plain loop over the dimensions
            d = np.sqrt(np.cumsum((self.v[near] - q) ** 2, axis=1)[:, -1])
            hit = np.flatnonzero(d <= kth)
            if len(hit) > 4 * k:
                hit = hit[d[hit] <= np.partition(d[hit], k - 1)[k - 1]]
            best += [(float(d[i]), int(j)) for i in hit for j in self.ids[near[i]]]
            best = heapq.nsmallest(k, best)
            if len(best) == k:
                kth = min(kth, best[-1][0])
        return best


def _valid(v: Column) -> Column:
    return (v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))


def nearest(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            dims: int = 8, confidence: float = 0.999, seed: int = 7, dim: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows found for
    every row where ``is_query`` (over the column ``_id``) holds."""
    if dims < 2 or dims % 2:
        raise ValueError("dims must be even: the stopping test uses the closed form of the chi-square law")
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_id").isNotNull() & F.coalesce(_valid(F.col("_v")), F.lit(False)))
    if dim is None:
        sizes = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
        dim = sizes.d if sizes else 0
    rows = rows.filter(F.size("_v") == dim)

    first = Window.partitionBy("_v").orderBy("_id")
    kinds = pin(rows.distinct().withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= k + 1)
                .groupBy("_v").agg(F.sort_array(F.collect_list("_id")).alias("_ids")))
    count = kinds.count()
    matrix = projection(dim, dims, seed)
    depth = max(0, math.ceil(math.log2(max(1, count) / BLOCK_ROWS)))
    sample = hash_sample(kinds, F.col("_ids")[0], SAMPLE_ROWS, seed).select("_v").toArrow() if depth else None
    pts = np.array(sample.column(0).to_pylist(), dtype=np.float64).reshape(-1, dim) @ matrix if depth else np.zeros((0, dims))
    cells = Cells(pts, depth, dims)
    stop = chi_square_quantile(confidence, dims)

    def vectors(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = cells.block(vectors(b.column("_v")) @ matrix)
                yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns], names=["_block", *b.schema.names])

    index = pin(map_arrow(kinds, place, "_block long, _v array<double>, _ids array<long>"))
    parts = pin(index.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).cast("int").alias("_parts")))
    dealt = index.join(parts, "_block").select("_block", F.pmod(F.xxhash64("_ids"), F.col("_parts")).cast("int").alias("_part"), "_v", "_ids")
    asked = pin(rows.filter(is_query).distinct())
    distinct = asked.groupBy("_v").agg(F.min("_id").alias("_q"))
    asked = asked.join(distinct, "_v").select("_id", "_q")
    home = map_arrow(distinct, place, "_block long, _v array<double>, _q long").withColumn("_bound", F.lit(float("inf")))
    found = "_q long, _v array<double>, _block long, _kth double, _dist array<double>, _near array<long>"

    def search(key, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        tree = BlockTree(np.stack(block["_v"].to_list()), block["_ids"].to_list(), matrix) if len(block) and len(queries) else None
        for q, v, bound in zip(queries["_q"], queries["_v"], queries["_bound"], strict=True):
            best = tree.search(v, v @ matrix, k + 1, stop, bound) if tree else []
            kth = best[-1][0] if len(best) == k + 1 else bound
            out.append((q, v, key[0], kth, [d for d, _ in best], [i for _, i in best]))
        return pd.DataFrame(out, columns=["_q", "_v", "_block", "_kth", "_dist", "_near"])

    def by_block(queries: DataFrame) -> DataFrame:
        """Each query against every part of its block; the rows of a part are repeated
        for each ``QUERIES`` queries."""
        queries = pin(queries)
        slices = queries.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_slices"))
        asking = queries.join(slices, "_block").join(parts, "_block").select(
            "_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
            F.pmod(F.xxhash64("_q"), F.col("_slices")).cast("int").alias("_slice"), "_q", "_v", "_bound")
        there = dealt.join(slices, "_block").select(
            "_block", "_part", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice"), "_v", "_ids")
        key = ["_block", "_part", "_slice"]
        return pin(there.groupBy(*key).cogroup(asking.groupBy(*key)).applyInPandas(search, found))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each further block that the test still admits."""
        for b in batches:
            if b.num_rows:
                pts = vectors(b.column("_v")) @ matrix
                kth = b.column("_kth").to_numpy()
                at = [np.flatnonzero((g := cells.gap2(p)) <= stop * d * d if math.isfinite(d) else g >= 0)
                      for p, d in zip(pts, kth, strict=True)]
                at = [a[a != own] for a, own in zip(at, b.column("_block").to_pylist(), strict=True)]
                pick = pa.array(np.repeat(np.arange(b.num_rows), [len(a) for a in at]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(at)), b.column("_v").take(pick), b.column("_q").take(pick),
                     b.column("_kth").take(pick)], names=["_block", "_v", "_q", "_bound"])

    near = by_block(home)
    if len(cells.low) > 1:
        known = near.groupBy("_q", "_v", "_block").agg(F.min("_kth").alias("_kth"))
        far = by_block(map_arrow(known, onward, "_block long, _v array<double>, _q long, _bound double"))
        near = near.unionByName(far)
    pairs = near.select("_q", F.explode(F.arrays_zip("_dist", "_near")).alias("_p")).select(
        "_q", F.col("_p._dist").alias("_d"), F.col("_p._near").alias("_i"))
    order = Window.partitionBy("_q").orderBy("_d", "_i")
    top = pairs.distinct().withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k + 1)
    lists = top.groupBy("_q").agg(F.sort_array(F.collect_list(F.struct("_d", "_i"))).alias("_l"))
    own = asked.join(lists, "_q").select(
        "_id", F.slice(F.filter("_l", lambda x: x["_i"] != F.col("_id")), 1, k).alias("_l"))
    return own.select(F.col("_id").alias("query_id"), F.posexplode("_l").alias("_k", "_x")).select(
        "query_id", (F.col("_k") + 1).alias("rank"), F.col("_x._i").alias("vec_id"), F.col("_x._d").alias("score"))
