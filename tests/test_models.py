"""Model orchestration: fixed seeds, AUC above chance, stable cluster ids."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from martwright.operators import train as T


def _separable(spark, n=400):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        y = i % 2
        rows.append((i, y, rnd.gauss(2.0 * y, 1.0), rnd.gauss(0, 1)))
    return spark.createDataFrame(rows, "id int, label int, x1 double, x2 double")


def test_classifiers_beat_chance(spark):
    df = T.assembled(_separable(spark), ["x1", "x2"])
    for name, params in (("lr", {"maxIter": 20}), ("dt", {"maxDepth": 3}), ("nb", {}), ("rf", {"numTrees": 10}),
                         ("gbt", {"maxIter": 5}), ("mlp", {"maxIter": 50}), ("svc", {"maxIter": 20})):
        m = T.make_classifier(name, 2, **params).fit(df)
        row = T.evaluation(T.scored(m, df), name).first()
        assert row.model == name and row.auc > 0.75 and row.recall > 0.5 and row.weighted_precision > 0.6
        assert abs(row.auc - T.model_auc(m, df)) < 1e-12


def test_stepwise_picks_informative_feature(spark):
    df = _separable(spark)
    log = T.stepwise_auc(df.where("id % 2 = 0 OR id < 300"), df.where("id >= 300"), ["x2", "x1"],
                         max_steps=1, maxIter=10).collect()
    assert log[0].added == "x1"


def test_kmeans_stable_ids(spark):
    rows = [(float(x), 0.0) for x in range(10)] + [(100.0 + x, 0.0) for x in range(5)]
    df = spark.createDataFrame(rows, "a double, b double")
    out1, c1 = T.kmeans_segments(df, ["a", "b"], k=2, seed=1)
    out2, c2 = T.kmeans_segments(df, ["a", "b"], k=2, seed=7)
    assert [r.size for r in c1.orderBy("cluster").collect()] == [10, 5]
    assert sorted(map(tuple, out1.collect())) == sorted(map(tuple, out2.collect()))
    assert out1.where("a < 50").select(F.max("cluster")).first()[0] == 0


def test_model_auc_matches_evaluator_and_is_stable(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df = T.assembled(_separable(spark, 600), ["x1", "x2"])
    m = T.make_classifier("lr", 2, maxIter=10).fit(df)
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(m.transform(df))
    runs = {round(T.model_auc(m, df), 12) for _ in range(3)}
    assert len(runs) == 1
    assert abs(runs.pop() - ev) < 1e-9


def test_stepwise_runs_to_the_end_and_survives_one_class(spark):
    df = _separable(spark)
    log = T.stepwise_auc(df.where("id < 300"), df.where("id >= 300"), ["x2", "x1"], maxIter=10).collect()
    assert [r.step for r in log] == [1, 2] and log[1].features == "x1,x2"
    one = T.stepwise_auc(df.where("id < 300"), df.where("id >= 300 AND label = 1"), ["x2", "x1"], maxIter=5).collect()
    assert [r.added for r in one] == ["x2", "x1"] and one[0].auc_test is None


def test_cross_validation_covers_the_grid(spark):
    df = T.assembled(_separable(spark, 200), ["x1", "x2"])
    best, table = T.cross_validate(df, "dt", T.GRIDS["dt"], folds=3)
    rows = table.collect()
    assert [r.params for r in rows] == ["maxDepth=4", "maxDepth=10"] and all(r.avg_auc > 0.5 for r in rows)
    assert T.model_auc(best, df) > 0.75


@pytest.mark.parametrize(("name", "grid"), [("dt", {"maxDepth": [1, 3]}), ("rf", {"numTrees": [3, 5]}), ("lr", {"regParam": [0.0, 5.0]})])
def test_cross_validation_equals_sparks_and_fits_read_two_columns(spark, monkeypatch, name, grid):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    df = T.assembled(_separable(spark, 300), ["x1", "x2"])
    est = T.make_classifier(name, 2)
    (param, values), = grid.items()
    want = CrossValidator(estimator=est, estimatorParamMaps=ParamGridBuilder().addGrid(est.getParam(param), values).build(),
                          evaluator=BinaryClassificationEvaluator(), numFolds=3, seed=1).fit(df)
    seen, real = [], type(est).fit
    monkeypatch.setattr(type(est), "fit", lambda self, data, params=None: seen.append(data.columns) or real(self, data, params))
    best, table = T.cross_validate(df, name, grid, folds=3, parallelism=4)
    assert [r.avg_auc for r in table.collect()] == pytest.approx(want.avgMetrics, abs=1e-12)
    assert T.model_auc(best, df) == pytest.approx(T.model_auc(want.bestModel, df), abs=1e-12)
    assert len(seen) == 7 and all(set(c) <= {"features", "label", "_at"} for c in seen)


@pytest.mark.parametrize(("name", "grid"), [("dt", {"maxDepth": [1, 3]}), ("rf", {"numTrees": [3, 5]})])
def test_the_best_point_is_the_same_model_fitted_at_once_or_later(spark, monkeypatch, name, grid):
    df = T.assembled(_separable(spark, 300), ["x1", "x2"])
    best, table = T.cross_validate(df, name, grid, folds=3)
    fits, est = [], type(T.make_classifier(name, 2))
    real = est.fit
    monkeypatch.setattr(est, "fit", lambda self, data, params=None: fits.append(self.uid) or real(self, data, params))
    none, again = T.cross_validate(df, name, grid, folds=3, refit=False)
    assert none is None and len(fits) == 6 and again.collect() == table.collect()
    later = T.fit_best(df, name, {r.params: r.avg_auc for r in again.collect()}, grid)
    assert later.toDebugString.split("\n")[1:] == best.toDebugString.split("\n")[1:]
    tied = T.fit_best(df, name, dict.fromkeys([r.params for r in again.collect()], 0.5), grid)
    (param, values), = grid.items()
    assert tied.getOrDefault(param) == values[0]


def test_grids_alone_fit_no_compared_model(spark, sf_dir, monkeypatch):
    """``cv_grid`` reads averages alone: nothing is fitted on the whole set, and no further model."""
    from martwright.plans import pinned
    from martwright.plans import q_model as Q
    fits, real = [], T.make_classifier
    monkeypatch.setattr(T, "GRIDS", {"dt": {"maxDepth": [2, 3]}, "nb": {}})
    monkeypatch.setattr(Q, "_FURTHER", {"svc": {"maxIter": 5}})
    monkeypatch.setattr(T, "make_classifier", lambda n, *a, **k: fits.append(n) or real(n, *a, **k))
    later = []
    monkeypatch.setattr(T, "fit_best", lambda *a, _real=T.fit_best, **k: later.append(a[1]) or _real(*a, **k))
    pinned._KEPT.clear()
    assert entry.queries()["cv_grid"](spark, sf_dir).count() == 3 and "svc" not in fits and later == []
    rows = entry.queries()["model_comparison"](spark, sf_dir).collect()
    pinned._KEPT.clear()
    assert [r.model for r in rows] == ["dt", "svc"] and later == ["dt"]


def test_scores_are_ordered_with_ties_by_key(spark):
    df = T.assembled(spark.createDataFrame([(i, i % 2, float(i % 4)) for i in range(40)], "id int, label int, x double"), ["x"])
    got = [(r.p_positive, r.id) for r in T.score(T.make_classifier("dt", 1, maxDepth=2).fit(df), df, "id").collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1]))


@pytest.mark.parametrize(("name", "columns", "rows"), [
    ("train_random_forest", ["model", "auc", "accuracy", "precision", "recall"], 1),
    ("train_gbt", ["model", "auc", "accuracy", "precision", "recall"], 1),
    ("bank_segments", ["cluster", "size"], 3), ("churner_segments", ["cluster", "n"], 3),
    ("donor_campaign_auc", ["campaign", "auc"], 2), ("donor_segments", ["cluster", "column"], None),
    ("score_customers", ["customer_id", "p_positive", "prediction"], None),
    ("chi2_select", ["feature", "rank", "chi2"], 30), ("train_rbf_svc", ["model", "auc"], 1),
    ("pca_mart", ["customer_id", "components"], None), ("knn_visits", ["round", "share"], 3), ("pca_project", ["vec_id", "pca"], None)])
def test_model_queries(spark, sf_dir, name, columns, rows):
    out = entry.queries()[name](spark, sf_dir)
    got = out.collect()
    assert set(columns) <= set(out.columns) and (len(got) == rows if rows else got)
    if "auc" in columns:
        assert all(0 <= r.auc <= 1 for r in got)
    if "size" in columns or "n" in columns:
        assert all((r["size"] if "size" in columns else r["n"]) > 0 for r in got)
    if name == "pca_project":
        assert {len(r.pca) for r in got} == {10}


def test_donor_roc_ends_at_one_and_scores_are_ordered(spark, sf_dir):
    roc = entry.queries()["donor_campaign_roc"](spark, sf_dir).collect()
    for c in ("training", "next"):
        mine = sorted((r.fpr, r.tpr) for r in roc if r.campaign == c)
        assert mine[-1] == (1.0, 1.0) and all(a[1] <= b[1] for a, b in zip(mine, mine[1:], strict=False))
    s = [r.p_positive for r in entry.queries()["donor_campaign_scores"](spark, sf_dir).collect()]
    assert s == sorted(s, reverse=True)



def test_segments_take_the_named_features(spark, sf_dir):
    from martwright.plans import q_model as Q
    bank = entry.queries()["bank_segments"](spark, sf_dir)
    assert [c for c in bank.columns if c.endswith("_w_centre")] == [f"{c}_w_centre" for c in Q._BANK_SEGMENT] and len(Q._BANK_SEGMENT) == 9
    out = entry.queries()["churner_segments"](spark, sf_dir)
    assert "avg_days_without_sub" not in out.columns and "avg_n_subscriptions_2001" in out.columns
    assert Q.churn_features(Q._churn_mart(spark, sf_dir)) == Q.MART_FEATURES


def test_one_cross_validation_serves_both_queries(spark, sf_dir, monkeypatch):
    from martwright.plans import pinned
    from martwright.plans import q_model as Q
    fits = []
    monkeypatch.setattr(T, "GRIDS", {"dt": {"maxDepth": [2, 3]}, "nb": {}})
    monkeypatch.setattr(Q, "_FURTHER", {"svc": {"maxIter": 5}})
    real = T.cross_validate
    monkeypatch.setattr(T, "cross_validate", lambda *a, **k: fits.append(a[1]) or real(*a, **k))
    pinned._KEPT.clear()
    grid = entry.queries()["cv_grid"](spark, sf_dir).collect()
    rows = entry.queries()["model_comparison"](spark, sf_dir).collect()
    pinned._KEPT.clear()
    assert fits == ["dt", "nb"] and [r.params for r in grid if r.model == "dt"] == ["maxDepth=2", "maxDepth=3"]
    assert {r.model for r in rows} == {"dt", "svc"} and all(r.auc is not None and r.weighted_precision is not None for r in rows)


def test_classifiers_see_every_churn_feature(spark, sf_dir):
    from martwright.plans import q_model as Q
    mart = Q._churn_mart(spark, sf_dir)
    assert set(mart.columns) - set(Q.churn_features(mart)) == {"customer_id", "label", "days_without_sub", "last_end", "first_start"}
    train, _, zc = Q._churn_sets(spark, sf_dir)
    assert [f"{c}_z" for c in Q.churn_features(mart)] == zc and train.first().features.size == len(zc) >= 50


@pytest.mark.parametrize("name", ["stepwise_logistic", "stepwise_naive_bayes"])
def test_stepwise_is_offered_the_whole_donor_mart(spark, sf_dir, monkeypatch, name):
    from martwright.operators import stepwise as ST
    seen = {}
    monkeypatch.setattr(ST, name, lambda train, test, cands: seen.update(cands=list(cands), columns=train.columns))
    entry.queries()[{"stepwise_logistic": "stepwise_auc"}.get(name, name)](spark, sf_dir)
    assert set(seen["cands"]) == set(seen["columns"]) - {"donor_id", "campaign_amount", "label", "split"}
    assert any(c.startswith("province_") for c in seen["cands"])
