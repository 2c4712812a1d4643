"""Co-moments, radial features, quantile chi-square and pinned results."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import functions as F

from martwright.operators import comoments as CM
from martwright.operators import features as FT
from martwright.operators import kernels as KN
from martwright.operators import train as T
from martwright.plans import pinned

SCHEMA = "id int, a double, b double, c double, flat double, big double"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    out = []
    for i in range(500):
        a = rnd.gauss(0, 1)
        out.append((i, a, 3 * a + rnd.gauss(0, 1), None if i % 7 == 0 else rnd.random(), 4.0, 1e9 + a))
    out[3] = (3, float("nan"), None, 1.0, 4.0, 1e9)
    return out


def test_correlations_equal_corr(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    cols = ["a", "b", "c", "flat", "big"]
    got = {(r.a, r.b): r["corr"] for r in CM.correlation_rows(df, cols).collect()}
    clean = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])
    for x in cols:
        for y in cols:
            if "flat" in (x, y):
                assert got[x, y] is None
            else:
                assert abs(got[x, y] - clean.agg(F.corr(x, y)).first()[0]) < 1e-6, (x, y)
    about = CM.comoments(df, cols)
    cov = clean.agg(F.covar_samp("a", "b")).first()[0]
    assert math.isclose(about.covariance()[0, 1], cov, rel_tol=1e-9)


def test_components_equal_ml(spark, rows):
    df = spark.createDataFrame([r for r in rows if r[3] is not None and r[0] != 3], SCHEMA)
    cols = ["a", "b", "c"]
    m = PCA(k=2, inputCol="v", outputCol="p").fit(VectorAssembler(inputCols=cols, outputCol="v").transform(df))
    values, directions = CM.comoments(df, cols).components(2)
    for i in range(2):
        mine, theirs = directions[i], m.pc.toArray()[:, i]
        assert np.allclose(mine, theirs, atol=1e-8) or np.allclose(mine, -theirs, atol=1e-8)
    out = CM.project(df, cols, 2, keep=["id"], standardised=False)
    x = np.array([r.components for r in out.collect()])
    assert np.allclose(x.var(axis=0, ddof=1), values) and abs(np.corrcoef(x.T)[0, 1]) < 1e-9


def test_one_pass_whatever_the_width(spark):
    """Fifty columns: the plan holds no expression for each pair, and nothing sorts or joins."""
    df = spark.range(400).select("id", *[F.rand(i).alias(f"x{i}") for i in range(50)])
    assert CM.correlation_rows(df, [f"x{i}" for i in range(50)]).count() == 2500


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    for x in (df, df.limit(0)):
        assert {r["corr"] for r in CM.correlation_rows(x, ["a", "b"]).collect()} == {None}
        assert CM.project(x, ["a", "b"], 1).count() == x.count()


def test_radial_kernel_separates_rings(spark):
    rnd, out = random.Random(2), []
    for i in range(800):
        y, t = i % 2, rnd.uniform(0, 2 * math.pi)
        r = rnd.gauss(1 + 2 * y, 0.25)
        out.append((i, y, r * math.cos(t), r * math.sin(t)))
    df = spark.createDataFrame(out, "id int, label int, x double, y double")
    gamma = KN.scale_gamma(df, ["x", "y"])
    z = KN.fourier_features(df, ["x", "y"], gamma, keep=["id"], size=256)
    train, test = z.where("id < 500"), z.where("id >= 500")
    assert T.model_auc(T.make_classifier("svc", maxIter=50, regParam=1e-3).fit(train), test) > 0.95
    plain = T.assembled(df, ["x", "y"])
    assert T.model_auc(T.make_classifier("svc", maxIter=50).fit(plain.where("id < 500")), plain.where("id >= 500")) < 0.65
    # the features' products approach the kernel
    v = np.array([r.features.toArray() for r in KN.fourier_features(df.limit(20), ["x", "y"], gamma, size=4096).collect()])
    p = np.array([[r.x, r.y] for r in df.limit(20).collect()])
    want = np.exp(-gamma * ((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert np.abs(v @ v.T - want).max() < 0.1
    assert KN.fourier_features(df.limit(0), ["x"], 1.0).count() == 0 and KN.scale_gamma(df.limit(0), ["x"]) == 1.0


def test_chi2_top_by_plain_counts(spark):
    rnd, out = random.Random(6), []
    for i in range(700):
        y = i % 2
        out.append((i, y, rnd.gauss(y, 1), rnd.random(), float(rnd.randrange(3)) if i % 11 else None, 1.0))
    df = spark.createDataFrame(out, "id int, label int, near double, noise double, few double, flat double")
    got = FT.chi2_top(df, ["flat", "few", "noise", "near"], "label", 3, bins=4).collect()
    assert got[0].feature == "near" and [r["rank"] for r in got] == [1, 2, 3]

    def plain(k):
        v = sorted(r[k] for r in out if r[k] is not None)
        ends = sorted({v[math.ceil(len(v) * i / 4) - 1] for i in (1, 2, 3)})
        cells = {}
        for r in out:
            b = -1 if r[k] is None else sum(r[k] > e for e in ends)
            cells[b, r[1]] = cells.get((b, r[1]), 0) + 1
        rows, cols = {}, {}
        for (b, y), n in cells.items():
            rows[b], cols[y] = rows.get(b, 0) + n, cols.get(y, 0) + n
        return sum((cells.get((b, y), 0) - rows[b] * cols[y] / 700) ** 2 / (rows[b] * cols[y] / 700) for b in rows for y in cols)
    at = {"near": 2, "noise": 3, "few": 4, "flat": 5}
    assert all(abs(r.chi2 - plain(at[r.feature])) < 1e-5 for r in got)


def test_a_pinned_result_follows_its_files(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.read.parquet(str(tmp_path / "t")).agg(F.sum("id").alias("s"))
    spark.range(5).write.parquet(str(tmp_path / "t"))
    src = [spark.read.parquet(str(tmp_path / "t"))]
    assert pinned.once(spark, "s", src, build).first().s == 10 and pinned.once(spark, "s", src, build).first().s == 10 and made == [1]
    spark.range(7).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert pinned.once(spark, "s", [spark.read.parquet(str(tmp_path / "t"))], build).first().s == 21 and made == [1, 1]
    for i in range(pinned.MOST + 2):
        pinned.once(spark, f"more {i}", src[:0], lambda: spark.range(1).toDF("s"))
    assert len(pinned._KEPT) <= pinned.MOST
