"""Exact k nearest neighbours by a pruning join, and the classifier on them.

A handful of pivots is spread over a bounded sample.  Every row gets its distances
to the pivots; rows are range-partitioned by nearest pivot and the distance to it
into blocks of about ``block_rows`` rows (a cell with a third of all rows, or of
equal vectors, becomes many blocks).  A block is described by the least and the
greatest distance of its rows to every pivot, so by the triangle inequality no row of it is nearer
to a query than the largest gap between the query's own pivot distances and
these ranges.

Queries visit blocks in the order of this lower bound, in rounds: the likeliest
block, the next few, then all others.  After each round the k-th distance found so far
rules out every block whose bound exceeds it; a query ends when none is left.
The result is exact: what is not visited cannot hold a neighbour.

A visit is one row (query, block); pairs of rows are only ever formed inside a task,
one block against at most ``QUERIES`` queries at a time.  Block descriptions are
broadcast: there are at most ``MAX_BLOCKS`` of them, whatever the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

PIVOTS, SAMPLE = 24, 2_000
#: most blocks (beyond it blocks grow), queries that meet a block at a time
MAX_BLOCKS, QUERIES = 50_000, 1_024
#: blocks visited in the first rounds; then all that are left
ROUNDS = (1, 4)
#: room for rounding in a bound
SLACK = 1e-9


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, differences first (no cancellation), some rows at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def _pivots(rows: DataFrame, dims: int) -> np.ndarray:
    """Rows of a bounded sample (by hash of the id), each farthest from those before."""
    got = rows.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_v").toArrow()
    x = _matrix(got.column("_v").combine_chunks(), dims)
    pick = [0]
    near = _distances(x, x[:1])[:, 0]
    while len(pick) < min(PIVOTS, len(x)) and near.max() > 0:
        pick.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[pick[-1:]])[:, 0])
    return x[pick]


def _bounds(to_pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, blocks): no row of the block is nearer to the query."""
    out = np.zeros((len(to_pivots), len(low)))
    for j in range(low.shape[1]):
        at = to_pivots[:, j:j + 1]
        np.maximum(out, np.maximum(low[:, j] - at, at - high[:, j]), out=out)
    return out


def k_nearest(df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, label_col: str,
              block_rows: int = 4_096) -> tuple[DataFrame, list[dict]]:
    """``_id, _near`` (array of ``distance, id, label``, nearest first, ties to the
    smaller id) for the rows that ``is_query`` selects, and what was visited, a
    dict for each round.

    A row is no neighbour of itself (of its id).  Rows without an id, or whose
    vector is null, empty, of another length than the rest, or holds nulls or
    non-finite numbers, take no part; rows without a label are no neighbours.
    Fewer than k candidates: all of them."""
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("_id"), vector.alias("_v"), F.col(label_col).cast("long").alias("_label"),
                     F.coalesce(is_query, F.lit(False)).alias("_q")).filter(
        F.col("_id").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & F.coalesce(fine, F.lit(False)))
    rows = cut_lineage(rows)
    size = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    near_type = "array<struct<distance:double,id:bigint,label:bigint>>"
    if size is None:
        return rows.select("_id", F.array().cast(near_type).alias("_near")), []
    dims = size.d
    rows = rows.filter(F.size("_v") == dims)
    pivots = _pivots(rows, dims)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _distances(_matrix(b.column("_v"), dims), pivots)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(axis=1) if len(d) else [], pa.int32()),
                 pa.array(d.min(axis=1) if len(d) else [], pa.float64())], names=[*b.schema.names, "_d", "_cell", "_r"])

    with_pivots = cut_lineage(rows.mapInArrow(placed, "_id long, _v array<double>, _label long, _q boolean, _d array<double>, _cell int, _r double"))
    held = with_pivots.filter("_label is not null")
    n_rows = held.count()
    n_blocks = min(MAX_BLOCKS, max(1, math.ceil(n_rows / block_rows)))
    blocks = cut_lineage(held.select("_id", "_v", "_label", "_d", "_cell", "_r").repartitionByRange(n_blocks, "_cell", "_r", "_id")
                         .withColumn("_block", F.spark_partition_id()).drop("_cell", "_r"))
    ends = [f(F.element_at("_d", j + 1)).alias(f"{n}{j}") for j in range(len(pivots)) for n, f in (("l", F.min), ("h", F.max))]
    about = blocks.groupBy("_block").agg(*ends).orderBy("_block").collect()         # at most MAX_BLOCKS rows
    names = np.array([r["_block"] for r in about], dtype=np.int64)
    low = np.array([[r[f"l{j}"] for j in range(len(pivots))] for r in about]).reshape(len(about), len(pivots))
    high = np.array([[r[f"h{j}"] for j in range(len(pivots))] for r in about]).reshape(len(about), len(pivots))
    told = df.sparkSession.sparkContext.broadcast((names, low, high))

    state = cut_lineage(with_pivots.filter("_q").select("_id", "_v", "_d").dropDuplicates(["_id", "_v"])
                        .withColumn("_near", F.array().cast(near_type)))
    n_queries, report, first = state.count(), [], 0
    for upto in (*ROUNDS, None):
        def chosen(batches: Iterator[pa.RecordBatch], first=first, upto=upto) -> Iterator[pa.RecordBatch]:
            names, low, high = told.value
            for whole in batches:
                for i in range(0, whole.num_rows, 256):
                    b = whole.slice(i, 256)
                    bound = _bounds(_matrix(b.column("_d"), low.shape[1]), low, high) * (1 - SLACK)
                    order = np.argsort(bound, axis=1, kind="stable")[:, first:None if upto is None else first + upto]
                    kth = np.array([x[k - 1]["distance"] if len(x) >= k else math.inf for x in b.column("_near").to_pylist()])
                    q, at = np.nonzero(np.take_along_axis(bound, order, axis=1) <= kth[:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(names[order[q, at]], pa.int32()), b.column("_id").take(pa.array(q)),
                                                      b.column("_v").take(pa.array(q))], names=["_block", "_query", "_w"])

        visits = cut_lineage(state.mapInArrow(chosen, "_block int, _query long, _w array<double>")) if len(about) else None
        n_visits = visits.count() if visits is not None else 0
        report.append({"round": len(report) + 1, "queries": n_queries, "blocks": len(about), "rows": n_rows, "visits": n_visits})
        first += upto or 0
        if not n_visits:
            continue
        # a block and at most QUERIES queries meet in a task; the rows of a block much visited are repeated for each such part
        parts = visits.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("_parts"))
        asked = visits.join(parts, "_block").withColumn("_part", F.pmod(F.xxhash64("_query"), F.col("_parts")).cast("int")).drop("_parts")
        there = blocks.join(parts, "_block").select("_block", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), "_id", "_v", "_label")

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            ids, ql = right.column("_id").to_numpy(), left.column("_query").to_numpy()
            labels = right.column("_label").to_numpy()
            keep_q, keep = [], []
            if len(ids) and len(ql):
                d = _distances(_matrix(left.column("_w").combine_chunks(), dims), _matrix(right.column("_v").combine_chunks(), dims))
                d[ql[:, None] == ids[None, :]] = np.inf
                order = np.argsort(ids, kind="stable")
                for i, q in enumerate(ql.tolist()):
                    row = d[i, order]
                    best = np.argsort(row, kind="stable")[:k]
                    keep_q.append(q)
                    keep.append([{"distance": float(row[j]), "id": int(ids[order[j]]), "label": int(labels[order[j]])}
                                 for j in best if row[j] < np.inf])
            return pa.table({"_id": pa.array(keep_q, pa.int64()), "_block": pa.array([left.column("_block")[0].as_py() if len(ql) else 0] * len(keep_q), pa.int32()),
                             "_near": pa.array(keep, pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64()), ("label", pa.int64())])))})

        found = asked.groupBy("_block", "_part").cogroup(there.groupBy("_block", "_part")).applyInArrow(
            nearest, f"_id long, _block int, _near {near_type}")

        def best(groups: list[str], of: DataFrame) -> DataFrame:
            return of.groupBy(*groups).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near"))
        merged = best(["_id"], best(["_id", "_some"], found.withColumn("_some", F.col("_block") % 64)))
        state = cut_lineage(state.alias("s").join(merged.alias("m"), "_id", "left").select(
            "_id", "_v", "_d", F.slice(F.array_sort(F.array_distinct(F.concat("s._near", F.coalesce("m._near", F.array().cast(near_type))))), 1, k).alias("_near")))
    return state.select("_id", "_near"), report


def knn_classify(df: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, label_col: str,
                 **kw) -> tuple[DataFrame, list[dict]]:
    """``id_col, predicted, votes``: the commonest label among the k nearest (ties: the
    smallest label), null without a neighbour; and what was visited."""
    near, report = k_nearest(df, is_query, k, id_col, vector_col, label_col, **kw)
    labels = F.transform("_near", lambda x: x["label"])
    tally = F.array_max(F.transform(F.array_distinct(labels), lambda v: F.struct(
        F.size(F.filter(labels, lambda x: x == v)).cast("long").alias("votes"), (-v).alias("label"))))
    return near.select(F.col("_id").alias(id_col), (-tally["label"]).alias("predicted"),
                       F.coalesce(tally["votes"], F.lit(0)).cast("long").alias("votes")), report
