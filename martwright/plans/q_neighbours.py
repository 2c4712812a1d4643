"""Catalogue: exact k nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as N
from .catalog import query, tables

K = 5


@query("knn_classify", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, c.label,
             list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))) AS d
      FROM v q JOIN v c ON c.vec_id <> q.vec_id AND c.label IS NOT NULL WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rn FROM p),
t AS (SELECT query_id, label, count(*) AS votes FROM r WHERE rn <= 5 GROUP BY query_id, label),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS rn FROM t)
SELECT v.vec_id, CAST(w.label AS BIGINT) AS predicted, CAST(coalesce(w.votes, 0) AS BIGINT) AS votes, CAST(v.label AS BIGINT) AS label
FROM v LEFT JOIN w ON v.vec_id = w.query_id AND w.rn = 1 WHERE v.vec_id % 50 = 0""")
def knn_classify(spark, sf):
    """Class of every 50th vector by the majority of its 5 nearest among all others."""
    (e,) = tables(spark, sf, "embeddings")
    got, _ = N.knn_classify(e, F.col("vec_id") % 50 == 0, K, "vec_id", "embedding", "label")
    return got.join(e.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id")


@query("knn_visits")
def knn_visits(spark, sf):
    """What the pruning join visits: a row for each round, with the share of all (query, block) pairs."""
    (e,) = tables(spark, sf, "embeddings")
    _, report = N.knn_classify(e, F.col("vec_id") % 50 == 0, K, "vec_id", "embedding", "label", block_rows=256)
    rows = [(r["round"], r["queries"], r["blocks"], r["rows"], r["visits"],
             r["visits"] / max(1, r["queries"] * r["blocks"])) for r in report]
    return spark.createDataFrame(rows, "round int, queries long, blocks long, rows long, visits long, share double")
