"""Batched forward selection against separate fits."""

import random

import pytest
from pyspark.sql import functions as F

from martwright.operators import stepwise as ST
from martwright.operators import train as T
from martwright.operators.evaluate import auc_by


def _rows(spark, n=600, seed=4):
    """Five features of differing weight, one a copy of another, one constant, ties and nulls."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        a, b, c = rnd.gauss(0, 1), rnd.randrange(4), rnd.gauss(5, 3)
        y = int(rnd.random() < 1 / (1 + 2.7 ** -(1.2 * a + 0.5 * b - 1 + 0.1 * c - 0.5)))
        rows.append((i, y, a, float(b), c, 2 * a + 1, 1.0))
    return spark.createDataFrame(rows, "id int, label int, a double, b double, c double, copy double, flat double").repartition(5)


NAMES = ["flat", "c", "b", "a", "copy"]


@pytest.mark.parametrize(("batched", "model", "params"), [
    (ST.stepwise_logistic, "lr", {"maxIter": 500, "tol": 1e-12}), (ST.stepwise_naive_bayes, "nb", {})])
def test_same_log_as_separate_fits(spark, batched, model, params):
    df = _rows(spark)
    train, test = df.where("id < 400"), df.where("id >= 400")
    got = batched(train, test, NAMES).collect()
    assert [r.step for r in got] == [1, 2, 3, 4, 5] and got[-1].auc_train > 0.7
    for r in got:                       # the models on the logged features, one by one
        tr, te = T.assembled(train, r.features.split(",")), T.assembled(test, r.features.split(","))
        m = T.make_classifier(model, r.step, **params).fit(tr)
        assert abs(T.model_auc(m, tr) - r.auc_train) < 1e-4 and abs(T.model_auc(m, te) - r.auc_test) < 1e-4
    one = T.stepwise_auc(train, test, NAMES, model=model, max_steps=2, **params).collect()
    assert [r.added for r in one] == [r.added for r in got[:2]]
    assert all(abs(a.auc_test - b.auc_test) < 1e-6 for a, b in zip(one, got, strict=False))


def test_fits_are_stationary(spark):
    """The gradient of the mean log-likelihood vanishes at every batched fit."""
    import numpy as np
    df = _rows(spark)
    blocks, _, n, s, q = ST._prepared(df.where("id < 400"), df.where("id >= 400"), NAMES, "label")
    mean = s.sum(axis=0) / n.sum()
    std = np.array([x if x > 1e-9 else 1.0 for x in np.sqrt(np.maximum(q.sum(axis=0) / n.sum() - mean ** 2, 0))])
    sets = [[1, 2], [1, 3], [3, 4]]
    coef = ST.fit_all(blocks, sets, [np.zeros(3)] * 3, mean, std, n.sum())
    rows = np.array([[r[c] for c in NAMES] + [r.label] for r in df.where("id < 400").collect()])
    for cols, w in zip(sets, coef, strict=True):
        x = np.column_stack([((rows[:, :-1] - mean) / std)[:, cols], np.ones(len(rows))])
        assert np.abs(x.T @ (rows[:, -1] - 1 / (1 + np.exp(-x @ w)))).max() / len(rows) < 1e-8


@pytest.mark.parametrize("ranges", [2, 256])
def test_auc_equals_the_sorted_one(spark, monkeypatch, ranges):
    import numpy as np
    monkeypatch.setattr(ST, "RANGES", ranges)
    df = _rows(spark, 900).withColumn("set", F.when(F.col("id") < 500, "train").otherwise("test"))
    blocks, sample, *_ = ST._prepared(df.where("set = 'train'"), df.where("set = 'test'"), ["a", "b"], "label")
    got = ST.auc_all(blocks, lambda rows: rows[:, :2], 2, sample)
    for g, c in enumerate(("a", "b")):
        want = {r["set"]: r.auc for r in auc_by(df, "label", c, "set").collect()}
        assert np.allclose(got[g], [want["train"], want["test"]], atol=1e-12)


@pytest.mark.parametrize("chunk", [1, 200])
def test_auc_counts_scores_across_chunks(spark, monkeypatch, chunk):
    """Scores counted a few rows at a time, ties, signed zeros and NaN among them, give the sorted AUC."""
    import numpy as np
    monkeypatch.setattr(ST, "CHUNK", chunk)
    monkeypatch.setattr(ST, "RANGES", 5)
    rnd = random.Random(8)
    rows = [(i, i % 3 % 2, rnd.choice([-1.5, -0.0, 0.0, 2.0, 1e-300, float("nan")]), rnd.gauss(0, 1)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, label int, a double, b double").repartition(9)
    df = df.withColumn("set", F.when(F.col("id") < 500, "train").otherwise("test"))
    blocks, sample, *_ = ST._prepared(df.where("set = 'train'"), df.where("set = 'test'"), ["a", "b"], "label")
    got = ST.auc_all(blocks, lambda rows: rows[:, :2], 2, sample)
    for g, c in enumerate(("a", "b")):
        want = {r["set"]: r.auc for r in auc_by(df, "label", c, "set").collect()}
        assert np.allclose(got[g], [want["train"], want["test"]], atol=1e-12)


def test_one_class_empty_and_separable(spark):
    df = _rows(spark)
    one = ST.stepwise_logistic(df.where("id < 300"), df.where("id >= 300 AND label = 1"), ["c", "a"]).collect()
    assert [r.added for r in one] == ["c", "a"] and one[0].auc_test is None and one[0].auc_train > 0.5
    same = ST.stepwise_logistic(df.where("label = 1"), df.where("id >= 300"), ["c", "a"]).collect()
    assert len(same) == 2 and same[0].auc_train is None
    assert ST.stepwise_naive_bayes(df.limit(0), df.limit(0), ["c"]).collect()[0].auc_test is None
    apart = df.withColumn("a", F.col("label") * 10 + F.col("a") / 100)
    assert ST.stepwise_logistic(apart.where("id < 300"), apart.where("id >= 300"), ["c", "a"], max_steps=1).collect()[0][1:] == ("a", "a", 1.0, 1.0)


def test_many_parts_are_merged_first(spark, monkeypatch):
    df = _rows(spark)
    want = ST.stepwise_logistic(df.where("id < 300"), df.where("id >= 300"), ["c", "a"]).collect()
    monkeypatch.setattr(ST, "MERGE", 2)
    got = ST.stepwise_logistic(df.where("id < 300").repartition(7), df.where("id >= 300"), ["c", "a"]).collect()
    assert [r.added for r in got] == [r.added for r in want]
    assert all(abs(a.auc_test - b.auc_test) < 1e-9 for a, b in zip(got, want, strict=True))
