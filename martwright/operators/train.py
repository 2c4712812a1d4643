"""Classifier training, cross-validation, stepwise selection, scoring, k-means.

Training is ``pyspark.ml`` (distributed fits); this module adds the
orchestration the reference wrote by hand: one declarative spec per model,
grid x k-fold CV, forward stepwise selection by test AUC, probability
scoring with a native vector element, and k-means segments with stable
cluster ids and centres in original units.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_element
from .evaluate import auc, auc_by


def make_classifier(name: str, n_features: int | None = None, seed: int = 1, **params):
    """Estimator by short name: rf, gbt, lr, dt, nb, mlp, svc."""
    common = dict(featuresCol="features", labelCol="label")
    if name == "rf":
        return RandomForestClassifier(seed=seed, **common, **params)
    if name == "gbt":
        return GBTClassifier(seed=seed, **common, **params)
    if name == "lr":
        # binomial always yields two-class outputs, even for a one-class fold
        return LogisticRegression(family=params.pop("family", "binomial"), **common, **params)
    if name == "dt":
        return DecisionTreeClassifier(seed=seed, **common, **params)
    if name == "nb":
        # gaussian: accepts negative (standardised) features
        return NaiveBayes(modelType=params.pop("modelType", "gaussian"), **common, **params)
    if name == "mlp":
        layers = params.pop("layers", [n_features or 1, 8, 2])
        return MultilayerPerceptronClassifier(layers=layers, seed=seed, **common, **params)
    if name == "svc":
        return LinearSVC(**common, **params)
    raise ValueError(f"unknown classifier {name!r}")


# The hyper-parameter grids of the reference's CV runs.
GRIDS = {
    "nb": {"smoothing": [0.01, 1.0]},
    "lr": {"maxIter": [10, 150]},
    "rf": {"numTrees": [150, 300]},
    "dt": {"maxDepth": [4, 10]},
    "gbt": {"maxDepth": [2, 4]},
}


# binary label declared as a two-valued nominal attribute, so estimators and
# evaluators see two classes even in a fold that holds only one of them
BINARY_LABEL_META = {"ml_attr": {"type": "nominal", "num_vals": 2, "name": "label"}}


def assembled(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """``features`` vector + double binary ``label``, plus the original columns."""
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    y = F.col(label).cast("double").alias("label", metadata=BINARY_LABEL_META)
    return va.transform(df.withColumn("label", y))


def score(model, df: DataFrame, key: str, positive: int = 1, descending: bool = True) -> DataFrame:
    """Model output with ``p_positive`` (native vector element) and
    ``prediction``; sorted by the score (descending for campaigns), ties by ``key``."""
    out = model.transform(df)
    if "probability" in out.columns:
        p = vector_element("probability", positive)
    else:  # LinearSVC: raw margin as score
        p = vector_element("rawPrediction", positive)
    out = out.withColumn("p_positive", p)
    return out.orderBy(F.col("p_positive").desc() if descending else F.col("p_positive").asc(), F.col(key))


def model_auc(model, df: DataFrame) -> float:
    s = model.transform(df)
    col = "probability" if "probability" in s.columns else "rawPrediction"
    s = s.select("label", vector_element(col, 1).alias("s"))
    return auc(s, "label", "s").first()["auc"]


def scored(model, df: DataFrame, *keep: str) -> DataFrame:
    """``label, prediction, s`` (score of the positive class) and the columns to keep."""
    out = model.transform(df)
    col = "probability" if "probability" in out.columns else "rawPrediction"
    return out.select(*keep, "label", "prediction", vector_element(col, 1).alias("s"))


def evaluation(pred: DataFrame, name: str) -> DataFrame:
    """One row ``model, auc, accuracy, weighted_precision, precision, recall``
    from stored predictions (``label, prediction, s``)."""
    from .evaluate import binary_metrics, weighted_precision
    names = ["auc", "accuracy", "weighted_precision", "precision", "recall"]
    parts = [binary_metrics(pred, "label", "prediction", name).drop("model"),
             weighted_precision(pred, "label", F.col("prediction")), auc(pred, "label", "s")]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(c).alias(c) for c in names]).select(F.lit(name).alias("model"), *names)


def side_by_side(spark, tasks: Sequence, workers: int) -> list:
    """Results of the tasks (calls that run Spark jobs) in their order, ``workers`` of them at a time."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max_workers=max(workers, 1)) as ex:
        return list(ex.map(lambda task: task(), [wrap(t) for t in tasks]))


def _grid(name: str, grid: Mapping[str, list] | None, n_features: int | None, seed: int):
    """Estimator and the points of its grid, by their name in the table."""
    est = make_classifier(name, n_features, seed)
    if name == "rf":
        # the node that each row has come to is kept, not found again from the root at
        # every level of every tree; draws and trees are the same
        est = est.setCacheNodeIds(True)
    pg = ParamGridBuilder()
    for p, vals in (grid or GRIDS.get(name, {})).items():
        pg = pg.addGrid(est.getParam(p), vals)
    return est, {", ".join(f"{k.name}={v}" for k, v in pm.items()): pm for pm in pg.build()}


def fit_best(train: DataFrame, name: str, averages: Mapping[str, float], grid: Mapping[str, list] | None = None,
             seed: int = 1, n_features: int | None = None):
    """The grid point of the highest average (by its ``params`` in the table of
    ``cross_validate``; of equal ones the first), fitted on the whole set."""
    est, points = _grid(name, grid, n_features, seed)
    at = int(np.argmax([averages[p] for p in points]))
    return est.fit(train.select("features", "label"), list(points.values())[at])


def cross_validate(train: DataFrame, name: str, grid: Mapping[str, list] | None = None,
                   folds: int = 5, seed: int = 1, parallelism: int = 2, n_features: int | None = None,
                   refit: bool = True):
    """Grid x k-fold CV by AUC; returns (best model, per-grid-point table).  Without
    ``refit`` no model is fitted on the whole set (None; ``fit_best`` can do it later)."""
    spark = train.sparkSession
    est, points = _grid(name, grid, n_features, seed)
    evaluator = BinaryClassificationEvaluator(metricName="areaUnderROC")
    # the columns that the fits read, kept once for all folds and fits
    rows = train.select("features", "label")
    if not train.is_cached:
        rows = rows.persist()
    drawn, share = rows.select("*", F.rand(seed).alias("_at")), 1.0 / folds

    def measured(fold, point):
        held = (F.col("_at") >= fold * share) & (F.col("_at") < (fold + 1) * share)
        model = est.fit(drawn.where(~held), point)
        return evaluator.evaluate(model.transform(drawn.where(held)))

    try:
        # as in CrossValidator, but the points of all folds side by side
        got = side_by_side(spark, [partial(measured, i, p) for i in range(folds) for p in points.values()], parallelism)
        averages = dict(zip(points, map(float, np.reshape(got, (folds, -1)).mean(axis=0)), strict=True))
        best = fit_best(rows, name, averages, grid, seed, n_features) if refit else None
    finally:
        if not train.is_cached:
            rows.unpersist()
    table = spark.createDataFrame([(name, p, a) for p, a in averages.items()], "model string, params string, avg_auc double")
    return best, table


def stepwise_auc(train: DataFrame, test: DataFrame, candidates: Sequence[str],
                 model: str = "lr", max_steps: int | None = None, parallelism: int = 4,
                 seed: int = 1, **params) -> DataFrame:
    """Forward stepwise selection by test AUC.

    Each step fits one model per unused candidate (candidates of a step run
    in a thread pool, each fit a distributed job on the given frames, which
    should be pinned) and keeps the feature with the best test AUC; of equal
    ones the first in the candidates' order.  A set with one class has no AUC:
    it counts as the lowest and is logged as null.  Returns the log ``(step,
    added, features, auc_train, auc_test)``, one row per step.
    """
    spark = train.sparkSession
    chosen: list[str] = []
    log = []
    steps = min(max_steps or len(candidates), len(candidates))

    def fit_eval(feat):
        cols = chosen + [feat]
        tr, te = assembled(train, cols), assembled(test, cols)
        m = make_classifier(model, len(cols), seed, **params).fit(tr)
        # train and test AUC in one pass over the union of both scored sets
        both = m.transform(tr).withColumn("_set", F.lit("train")).unionByName(
            m.transform(te).withColumn("_set", F.lit("test")), allowMissingColumns=True)
        col = "probability" if "probability" in both.columns else "rawPrediction"
        res = {r["_set"]: r["auc"] for r in
               auc_by(both.select("_set", "label", vector_element(col, 1).alias("s")),
                      "label", "s", "_set").collect()}
        return feat, res.get("train"), res.get("test")

    for step in range(1, steps + 1):
        rest = [c for c in candidates if c not in chosen]
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            res = list(ex.map(fit_eval, rest))
        best = max(res, key=lambda r: -1.0 if r[2] is None else r[2])
        chosen.append(best[0])
        log.append((step, best[0], ",".join(chosen), best[1], best[2]))
    return spark.createDataFrame(
        log, "step int, added string, features string, auc_train double, auc_test double")


def kmeans_segments(df: DataFrame, features: Sequence[str], k: int, seed: int = 1,
                    max_iter: int = 20):
    """k-means (k-means||) on the given (already scaled) columns.

    Cluster ids are relabelled by size (desc) then first centre coordinate,
    so reruns give the same ids.  Returns ``(assigned rows, centres)`` where
    centres has one row per cluster: ``cluster, size, <feature>...``.
    """
    va = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    x = va.transform(df)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features",
                   predictionCol="_raw_cluster").fit(x)
    centres = model.clusterCenters()
    assigned = model.transform(x)
    sizes = {r["_raw_cluster"]: r["n"] for r in
             assigned.groupBy("_raw_cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(range(len(centres)), key=lambda i: (-sizes.get(i, 0), float(centres[i][0])))
    relabel = {raw: new for new, raw in enumerate(order)}
    mapping = F.create_map(*[F.lit(x) for kv in relabel.items() for x in kv])
    out = assigned.withColumn("cluster", mapping[F.col("_raw_cluster")]).drop("_raw_cluster", "features")
    spark = df.sparkSession
    rows = [(relabel[i], int(sizes.get(i, 0)), *[float(v) for v in centres[i]]) for i in range(len(centres))]
    schema = "cluster int, size long, " + ", ".join(f"`{c}` double" for c in features)
    return out, spark.createDataFrame(sorted(rows), schema)


def cluster_profile(df: DataFrame, cluster: str, columns: Sequence[str]) -> DataFrame:
    """Count and mean of each column per cluster (one aggregate)."""
    from .aggregate import agg_expr
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                   *[agg_expr("mean", c).alias(f"avg_{c}") for c in columns])
