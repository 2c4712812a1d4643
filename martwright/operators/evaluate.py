"""Model evaluation as DataFrames: confusion counts, metrics, AUC, ROC, gains.

Everything is an aggregate.  Curves first collapse rows to one row per
distinct score (a partial aggregate, so a score shared by a third of the
rows becomes one row), then take running sums with ``prefix_sums`` instead
of a single-task global window.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import global_rank, ntile_from_rank, prefix_sums


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion_matrix(df: DataFrame, label, prediction) -> DataFrame:
    """One row ``tp, fp, tn, fn`` (four ``count_if`` in one pass)."""
    y, p = _c(label), _c(prediction)
    return df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"))


def binary_metrics(df: DataFrame, label, prediction, model: str) -> DataFrame:
    """``model, accuracy, precision, recall`` from the confusion counts;
    an empty denominator gives null."""
    cm = confusion_matrix(df, label, prediction)
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return cm.select(F.lit(model).alias("model"),
                     F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                     F.try_divide(tp, tp + fp).alias("precision"),
                     F.try_divide(tp, tp + fn).alias("recall"))


def metrics_table(df: DataFrame, label, predictions: Mapping[str, Column | str]) -> DataFrame:
    """Metrics of several models, one row each, from one aggregate over the rows."""
    y, names = _c(label), list(predictions)
    counts = []
    for i, n in enumerate(names):
        p = _c(predictions[n])
        counts += [F.count_if((y == a) & (p == b)).alias(f"c{i}_{a}{b}") for a in (0, 1) for b in (0, 1)]
    rows = []
    for i, n in enumerate(names):
        tn, fp, fn, tp = (F.col(f"c{i}_{ab}").cast("double") for ab in ("00", "01", "10", "11"))
        rows.append(F.struct(F.lit(n).alias("model"), F.try_divide(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                             F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")))
    return df.agg(*counts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def weighted_precision(df: DataFrame, label, prediction) -> DataFrame:
    """Sum over classes of precision(class) x share of the class in the labels."""
    # one aggregate over the rows; the rest works on a row per (label, prediction),
    # each seen from both ends; rows without a label are a class
    cells = df.groupBy(_c(label).cast("double").alias("y"), _c(prediction).cast("double").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    ends = cells.select("n", F.col("y").eqNullSafe(F.col("p")).alias("right"), F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.lit(True).alias("said")),
        F.struct(F.col("p").alias("cls"), F.lit(False).alias("said")))).alias("e"))
    n_if = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    j = ends.groupBy("e.cls").agg(n_if(F.col("e.said")).alias("n_label"), n_if(~F.col("e.said")).alias("n_pred"),
                                  n_if(F.col("right") & F.col("e.said")).alias("n_correct"))
    prec = F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("n_pred").cast("double")),
                      F.lit(0.0))
    # one row per class: the class-share denominator is the sum of the class counts
    return j.agg(F.try_divide(F.sum(prec * F.col("n_label")), F.sum("n_label").cast("double"))
                 .alias("weighted_precision"))


def score_counts(df: DataFrame, label, score) -> DataFrame:
    """One row per distinct score: positives and negatives."""
    y = _c(label)
    return df.groupBy(_c(score).alias("score")).agg(
        F.count_if(y == 1).cast("long").alias("pos"), F.count_if(y == 0).cast("long").alias("neg"))


def roc_table(df: DataFrame, label, score, **kw) -> DataFrame:
    """Per distinct score (descending): counts at or above it and the ROC
    point ``(fpr, tpr)`` of thresholding at that score."""
    cum = prefix_sums(score_counts(df, label, score), [("score", True)], ["pos", "neg"], **kw)
    # the totals come from the pinned score rows, not from the data again
    tot = cum.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).first()
    return cum.select(
        "score", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        F.try_divide(F.col("cum_neg").cast("double"), F.lit(float(tot["N"] or 0))).alias("fpr"),
        F.try_divide(F.col("cum_pos").cast("double"), F.lit(float(tot["P"] or 0))).alias("tpr"))


def auc(df: DataFrame, label, score, **kw) -> DataFrame:
    """Area under the ROC curve with ties counted half (Mann-Whitney):
    ``sum(pos * (neg_below + neg/2)) / (P * N)`` over distinct scores."""
    sc = score_counts(df, label, score)
    cum = prefix_sums(sc, [("score", False)], ["neg"], inclusive=False, **kw)
    return cum.agg(
        F.try_divide(F.sum(F.col("pos").cast("double") * (F.col("cum_neg") + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def auc_by(df: DataFrame, label, score, group: str, **kw) -> DataFrame:
    """AUC per ``group`` (e.g. train/test, or model) in one pass: score
    counts per ``(group, score)``, one prefix sum over ``(group, score)``,
    and each group's own starting offset subtracted (the first row of a
    group carries the negatives of all earlier groups)."""
    y = _c(label)
    sc = df.groupBy(F.col(group).alias("_g"), _c(score).alias("score")).agg(
        F.count_if(y == 1).cast("long").alias("pos"), F.count_if(y == 0).cast("long").alias("neg"))
    cum = prefix_sums(sc, [("_g", False), ("score", False)], ["neg"], inclusive=False, **kw)
    start = cum.groupBy(F.col("_g").alias("_s")).agg(F.min("cum_neg").alias("_off"))
    j = cum.join(start, F.col("_g").eqNullSafe(F.col("_s")))
    below = F.col("cum_neg") - F.col("_off")
    return j.groupBy(F.col("_g").alias(group)).agg(
        F.try_divide(F.sum(F.col("pos").cast("double") * (below + F.col("neg") / 2.0)),
                     F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"))


def positives_by_score(df: DataFrame, label, score) -> DataFrame:
    return df.groupBy(_c(score).alias("score")).agg(F.sum(_c(label)).alias("positives"),
                                                    F.count(F.lit(1)).alias("n"))


def gains_by_decile(df: DataFrame, label: str, score: str, key: list[str], buckets: int = 10,
                    **kw) -> DataFrame:
    """Cumulative gains and lift per score decile (``NTILE`` by score
    descending, ties broken by ``key``): rows, positives, cumulative
    positives, share of all positives captured, response rate, lift."""
    ranked = global_rank(df.select(label, score, *key), [(score, True)] + [(k, False) for k in key],
                         "rank", **kw)
    st = df.agg(F.count(F.lit(1)).alias("n_all"), F.sum(label).alias("p_all")).first()
    n_all, p_all = F.lit(st["n_all"]), F.lit(st["p_all"])
    t = ranked.withColumn("decile", ntile_from_rank("rank", n_all, buckets))
    d = t.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"))
    # ``buckets`` rows: one range is enough
    c = prefix_sums(d, [("decile", False)], ["n", "positives"], pin=False, n_ranges=1)
    dbl = lambda x: x.cast("double")
    return c.select("decile", "n", "positives", F.col("cum_positives"),
                    F.try_divide(dbl(F.col("cum_positives")), dbl(p_all)).alias("gain"),
                    F.try_divide(dbl(F.col("positives")), dbl(F.col("n"))).alias("response"),
                    F.try_divide(F.try_divide(dbl(F.col("cum_positives")), dbl(F.col("cum_n"))),
                                 F.try_divide(dbl(p_all), dbl(n_all))).alias("lift"))
