"""Catalogue: evaluation metrics, sampling and splits.

Label, score and prediction come from ``lineitem``: label = returned
(``l_returnflag = 'R'``), score = ``l_discount`` (11 distinct values, so
ties are exercised), prediction = ``l_discount >= 0.05``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import sampling as S
from .catalog import query, tables

_LBL = "CAST(l_returnflag = 'R' AS INTEGER)"


def _scored(spark, sf):
    (li,) = tables(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"),
                     F.col("l_discount").alias("score"), F.col("l_tax").alias("score2"),
                     (F.col("l_discount") >= 0.05).cast("int").alias("prediction"),
                     (F.col("l_tax") >= 0.04).cast("int").alias("prediction2"))


_CM = """COUNT(*) FILTER (WHERE y = 1 AND p = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
         COUNT(*) FILTER (WHERE y = 0 AND p = 0) AS tn, COUNT(*) FILTER (WHERE y = 1 AND p = 0) AS fn"""


@query("confusion_matrix", f"""
SELECT {_CM} FROM (SELECT {_LBL} AS y, CAST(l_discount >= 0.05 AS INTEGER) AS p FROM lineitem)""")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(_scored(spark, sf), "label", "prediction")


def _metrics_sql(model, pred):
    return f"""
SELECT '{model}' AS model, CAST(tp + tn AS DOUBLE) / (tp + fp + tn + fn) AS accuracy,
       CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0) AS recall
FROM (SELECT {_CM} FROM (SELECT {_LBL} AS y, CAST({pred} AS INTEGER) AS p FROM lineitem))"""


@query("binary_metrics", _metrics_sql("discount_ge_005", "l_discount >= 0.05") + " UNION ALL " +
       _metrics_sql("tax_ge_004", "l_tax >= 0.04"))
def binary_metrics(spark, sf):
    return E.metrics_table(_scored(spark, sf), "label",
                           {"discount_ge_005": "prediction", "tax_ge_004": "prediction2"})


@query("weighted_precision", f"""
WITH t AS (SELECT {_LBL} AS y, CAST(l_discount >= 0.05 AS INTEGER) AS p FROM lineitem),
pl AS (SELECT y AS cls, COUNT(*) AS n_label FROM t GROUP BY y),
pp AS (SELECT p AS cls, COUNT(*) AS n_pred, COUNT(*) FILTER (WHERE y = p) AS n_correct FROM t GROUP BY p)
SELECT SUM(COALESCE(CAST(n_correct AS DOUBLE) / n_pred, 0) * n_label) / CAST(SUM(n_label) AS DOUBLE) AS weighted_precision
FROM pl LEFT JOIN pp USING (cls)""")
def weighted_precision(spark, sf):
    return E.weighted_precision(_scored(spark, sf), "label", "prediction")


_SC = f"SELECT l_discount AS score, COUNT(*) FILTER (WHERE {_LBL} = 1) AS pos, COUNT(*) FILTER (WHERE {_LBL} = 0) AS neg FROM lineitem GROUP BY l_discount"


@query("auc_score", f"""
WITH s AS ({_SC}),
c AS (SELECT *, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT SUM(CAST(pos AS DOUBLE) * (below + neg / 2.0)) / (CAST(SUM(pos) AS DOUBLE) * CAST(SUM(neg) AS DOUBLE)) AS auc FROM c""")
def auc_score(spark, sf):
    return E.auc(_scored(spark, sf), "label", "score")


@query("roc_points", f"""
WITH s AS ({_SC}),
c AS (SELECT *, SUM(pos) OVER (ORDER BY score DESC) AS tp, SUM(neg) OVER (ORDER BY score DESC) AS fp,
             SUM(pos) OVER () AS P, SUM(neg) OVER () AS N FROM s)
SELECT score, pos, neg, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fp AS DOUBLE) / N AS fpr, CAST(tp AS DOUBLE) / P AS tpr FROM c""")
def roc_points(spark, sf):
    return E.roc_table(_scored(spark, sf), "label", "score")


@query("positives_by_score", f"""
SELECT l_discount AS score, CAST(SUM({_LBL}) AS BIGINT) AS positives, COUNT(*) AS n FROM lineitem GROUP BY l_discount""")
def positives_by_score(spark, sf):
    return E.positives_by_score(_scored(spark, sf), "label", "score")


@query("gains_by_decile", f"""
WITH t AS (SELECT {_LBL} AS y, NTILE(10) OVER (ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS decile
           FROM lineitem),
d AS (SELECT decile, COUNT(*) AS n, SUM(y) AS positives FROM t GROUP BY decile),
c AS (SELECT *, SUM(positives) OVER (ORDER BY decile) AS cp, SUM(n) OVER (ORDER BY decile) AS cn,
             SUM(positives) OVER () AS p_all, SUM(n) OVER () AS n_all FROM d)
SELECT CAST(decile AS INTEGER) AS decile, n, CAST(positives AS BIGINT) AS positives,
       CAST(cp AS BIGINT) AS cum_positives, cp / p_all AS gain, positives / n AS response,
       (cp / cn) / (p_all / n_all) AS lift FROM c""")
def gains_by_decile(spark, sf):
    return E.gains_by_decile(_scored(spark, sf), "label", "score", ["l_orderkey", "l_linenumber"])


# --------------------------------------------------------------------- sampling

_H = "substr(md5('123|' || CAST(o_orderkey AS VARCHAR)), 1, 8)"


@query("split_hash", f"""
SELECT o_orderkey, CASE WHEN {_H} < 'b3333333' THEN 'train' ELSE 'test' END AS split FROM orders""")
def split_hash(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return S.split_hash(o.select("o_orderkey"), ["o_orderkey"], 0.7, seed=123)


@query("split_stratified", f"""
SELECT o_orderkey, o_orderstatus,
  CASE WHEN ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY {_H}, o_orderkey)
            <= (COUNT(*) OVER (PARTITION BY o_orderstatus) * 7 + 5) // 10 THEN 'train' ELSE 'test' END AS split
FROM orders""")
def split_stratified(spark, sf):
    (o,) = tables(spark, sf, "orders")
    return S.split_stratified(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"],
                              0.7, seed=123)


@query("oversample", """
SELECT o_orderstatus, (SELECT MAX(c) FROM (SELECT COUNT(*) AS c FROM orders GROUP BY o_orderstatus)) AS n,
       COUNT(DISTINCT o_orderkey) AS n_distinct
FROM orders GROUP BY o_orderstatus""")
def oversample(spark, sf):
    (o,) = tables(spark, sf, "orders")
    s = S.oversample(o.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], seed=123)
    return s.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                          F.countDistinct("o_orderkey").alias("n_distinct"))
