"""Feature selection and vector features.

Correlations and chi-square statistics are plain aggregates (one pass,
partial aggregation, long output); vector steps are ``pyspark.ml``
estimators composed in a ``Pipeline`` that is fitted on the training set
and only *applied* to validation and scoring sets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, ChiSqSelector, Normalizer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corr_with_label(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each feature with the label: ``(feature, corr)``."""
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c)
                    for c in features])
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("corr")) for c in features]
    return wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def corr_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Full correlation matrix, long ``(a, b, corr)``, one aggregate pass
    (each unordered pair computed once and mirrored)."""
    exprs, pairs = [], []
    for i, a in enumerate(features):
        for b in features[i:]:
            nm = f"{a}\u0001{b}"
            exprs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(nm))
            pairs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{nm}`").alias("corr")))
            if a != b:
                pairs.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"`{nm}`").alias("corr")))
    return df.agg(*exprs).select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def corr_filter(corr: DataFrame, threshold: float = 0.12) -> DataFrame:
    """Keep features whose absolute correlation exceeds ``threshold``."""
    return corr.where(F.abs(F.col("corr")) > threshold)


def chi2_statistic(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson chi-square statistic of each categorical feature against the
    label: ``(feature, chi2, dof)``.

    Uses ``chi2 = n * (sum over observed cells of o^2 / (row * col) - 1)``,
    so only observed cells are needed: the contingency counts of all features
    are one partial aggregate, the marginals aggregates of those, joined on their
    keys (no cross product of categories and classes).
    """
    pairs = df.select(F.col(label).alias("y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in features])).alias("s"))
    obs = pairs.groupBy("s.f", "s.v", "y").agg(F.count(F.lit(1)).alias("o"))
    rows = obs.groupBy("f", "v").agg(F.sum("o").alias("rv"))
    cols = obs.groupBy("f", "y").agg(F.sum("o").alias("cy"))
    cells = obs.join(rows, ["f", "v"]).join(cols, ["f", "y"])
    agg = cells.groupBy("f").agg(F.sum(F.col("o").cast("double") ** 2 / (F.col("rv") * F.col("cy"))).alias("s"),
                                 F.sum("o").alias("n"), F.countDistinct("v").alias("nv"), F.countDistinct("y").alias("ny"))
    return agg.select(F.col("f").alias("feature"), (F.col("n") * (F.col("s") - 1)).alias("chi2"),
                      ((F.col("nv") - 1) * (F.col("ny") - 1)).cast("long").alias("dof"))


def quantile_bins(df: DataFrame, features: Sequence[str], bins: int = 10) -> dict[str, list[float]]:
    """Exact upper ends of all but the last of ``bins`` equally filled ranges of each
    column: the values at ranks ceil(n * i / bins), each once."""
    from .select import ranked_values
    # one long column, a group for each feature: the plan does not grow with their number
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in features])).alias("s")).select("s.*")
    wanted = {"v": [(i, i / bins, lambda n, i=i: F.floor((n * i + bins - 1) / bins)) for i in range(1, bins)]}
    out: dict[str, list[float]] = {c: [] for c in features}
    for r in ranked_values(long, wanted, "c").collect():                # bins - 1 numbers a column
        out[r["c"]].append(r["value"])
    return {c: sorted(set(v)) for c, v in out.items()}


def chi2_top(df: DataFrame, features: Sequence[str], label: str, top: int, bins: int = 10) -> DataFrame:
    """``feature, rank, chi2, dof``: the ``top`` columns, continuous ones too, whose
    quantile bins depend most on the label by the chi-square statistic (ties by name).
    Values without a bin (null) are a category of their own."""
    ends = quantile_bins(df, features, bins)
    binned = df.select(label, *[F.coalesce(sum(((F.col(f"`{c}`").cast("double") > e).cast("int") for e in ends[c]), F.lit(0)),
                                           F.lit(-1)).alias(c) for c in features])
    got = chi2_statistic(binned, features, label).select("feature", F.round("chi2", 6).alias("chi2"), "dof").collect()   # a row a column
    best = sorted(got, key=lambda r: (-(r.chi2 if r.chi2 is not None else -1.0), r.feature))[:top]
    return df.sparkSession.createDataFrame([(r.feature, i + 1, r.chi2, r.dof) for i, r in enumerate(best)],
                                           "feature string, rank int, chi2 double, dof long")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def feature_pipeline(features: Sequence[str], label: str = "label", n_top: int | None = None,
                     pca_k: int | None = None, l1: bool = False, standardize: bool = True) -> Pipeline:
    """assemble -> [chi-square top-n] -> [standardise] -> [L1 normalise] -> [PCA]."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error")]
    cur = "_raw"
    if n_top:
        stages.append(ChiSqSelector(numTopFeatures=n_top, featuresCol=cur, labelCol=label,
                                    outputCol="_sel"))
        cur = "_sel"
    if standardize:
        stages.append(StandardScaler(inputCol=cur, outputCol="_std", withMean=True, withStd=True))
        cur = "_std"
    if l1:
        stages.append(Normalizer(inputCol=cur, outputCol="_l1", p=1.0))
        cur = "_l1"
    if pca_k:
        stages.append(PCA(k=pca_k, inputCol=cur, outputCol="_pca"))
        cur = "_pca"
    stages.append(VectorAssembler(inputCols=[cur], outputCol="features"))
    return Pipeline(stages=stages)


def selected_names(model: PipelineModel, features: Sequence[str]) -> list[str]:
    """Names of the columns a fitted chi-square selector kept (indexes into
    the selector's *input* columns)."""
    for st in model.stages:
        if hasattr(st, "selectedFeatures"):
            return [features[i] for i in st.selectedFeatures]
    return list(features)
