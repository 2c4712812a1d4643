"""Catalogue: model training, CV, stepwise selection, scoring, segments.

Model outputs depend on the ML solvers, so these queries register no SQL
oracle; ``tests/`` checks their properties (AUC above chance on a separable
fixture, determinism under a fixed seed, stable cluster ids).  The two
queries that are plain relational work on top (cluster profile, churners
joined to the mart) do have oracles.
"""

from __future__ import annotations

from contextlib import contextmanager, nullcontext
from functools import partial, reduce

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import aggregate as G
from ..operators import comoments as CM
from ..operators import encode as EN
from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import kernels as KN
from ..operators import stepwise as ST
from ..operators import train as T
from ..operators.sampling import split_hash
from ..session import cut_lineage
from . import churn as CH
from . import donor as D
from .catalog import query, tables
from .pinned import once

# the key, the label, and what defines the label: the last end and the days since it
_CHURN_OUT = {"customer_id", "label", "days_without_sub", "last_end", "first_start"}


def churn_features(mart) -> list[str]:
    """Every numeric column of the mart but those that define the label."""
    return [c for c in mart.columns if c not in _CHURN_OUT]


def _churn_sources(spark, sf):
    return tables(spark, sf, "orders", "lineitem", "part", "events", "customer", "nation", "region")


def _churn_mart(spark, sf, **period):
    """The churn mart, pinned: built once in a session, whatever is fitted on it."""
    src = _churn_sources(spark, sf)
    return once(spark, f"churn_mart {sorted(period.items())}", src, lambda: CH.churn_mart(*src, **period))


def _churn_sets(spark, sf):
    mart = _churn_mart(spark, sf)
    feats = churn_features(mart)
    s = split_hash(mart, ["customer_id"], 0.7, seed=123)
    st = EN.zscore_fit(s.where("split = 'train'"), feats).first().asDict()
    zc = [f"{c}_z" for c in feats]
    a = T.assembled(EN.zscore_transform(s, st, feats), zc)
    return a.where("split = 'train'"), a.where("split = 'test'"), zc


def _train_query(name, **params):
    def run(spark, sf):
        train, test, zc = _churn_sets(spark, sf)
        m = T.make_classifier(name, len(zc), 1, **params).fit(train)
        pred = cut_lineage(T.scored(m, test))
        return T.evaluation(pred, name).drop("weighted_precision")
    return run


for _n, _p in {"logistic_regression": ("lr", {"maxIter": 50}),
               "random_forest": ("rf", {"numTrees": 30, "maxDepth": 5}),
               "gbt": ("gbt", {"maxIter": 20, "maxDepth": 3}),
               "decision_tree": ("dt", {"maxDepth": 4}),
               "naive_bayes": ("nb", {}),
               "mlp": ("mlp", {"maxIter": 100}),
               "linear_svc": ("svc", {"maxIter": 50})}.items():
    query(f"train_{_n}")(_train_query(_p[0], **_p[1]))


# the models compared and tuned, in the order of the reference; the last are further rows
_COMPARED = ["rf", "gbt", "lr", "dt"]
_FURTHER = {"nb": {}, "mlp": {"maxIter": 100}, "svc": {"maxIter": 50}}


@contextmanager
def _fit_sets(spark, sf):
    """Train and test set as fits and scores read them (two columns, not the mart twice
    over), kept meanwhile, and the number of features."""
    train, test, zc = _churn_sets(spark, sf)
    train, test = (s.select("features", "label").persist() for s in (train, test))
    try:
        yield train, test, len(zc)
    finally:
        train.unpersist()
        test.unpersist()


def _lanes(spark, names, run, beside):
    """``run(name)`` for every model, in the order of ``names``.  A forest fills the cores
    by itself and keeps its draws of every row: one after the other, and beside them
    ``beside`` at a time the models of many short jobs."""
    forests, rest = [n for n in names if n == "rf"], [n for n in names if n != "rf"]
    lane = lambda some, workers: T.side_by_side(spark, [partial(run, n) for n in some], workers)
    done = T.side_by_side(spark, [partial(lane, forests, 1), partial(lane, rest, beside)], 2)
    by_name = dict(zip(forests + rest, done[0] + done[1], strict=True))
    return [by_name[n] for n in names]


def _cross_validation(spark, sf, sets=None):
    """One cross-validation that both queries read, pinned once in a session: a row
    for every grid point (``model, params, avg_auc``)."""
    def build():
        with nullcontext(sets) if sets else _fit_sets(spark, sf) as (train, _, n_features):
            def grid(n):
                # the best of a grid is fitted on the whole set where models are compared
                at_once = 1 if n == "rf" else 4
                return T.cross_validate(train, n, folds=5, seed=1, parallelism=at_once, n_features=n_features, refit=False)[1]
            return reduce(lambda a, b: a.unionByName(b), _lanes(spark, list(T.GRIDS), grid, 1))
    return once(spark, "cross_validation", _churn_sources(spark, sf), build)


@query("cv_grid")
def cv_grid(spark, sf):
    """Mean AUC of every point of every model's grid, 5 folds."""
    return _cross_validation(spark, sf).select("model", "params", "avg_auc")


@query("model_comparison")
def model_comparison(spark, sf):
    """One row per model: the best of its grid by 5-fold AUC (the further
    models as they are), evaluated on the test set."""
    def build():
        with _fit_sets(spark, sf) as (train, test, n_features):
            averages = {}
            for r in _cross_validation(spark, sf, (train, test, n_features)).collect():
                averages.setdefault(r.model, {})[r.params] = r.avg_auc

            def row(n):
                if n in _FURTHER:
                    m = T.make_classifier(n, n_features, 1, **_FURTHER[n]).fit(train)
                else:
                    m = T.fit_best(train, n, averages[n], n_features=n_features)
                return T.evaluation(cut_lineage(T.scored(m, test)), n)
            names = [n for n in T.GRIDS if n in _COMPARED] + list(_FURTHER)
            return reduce(lambda a, b: a.unionByName(b), _lanes(spark, names, row, 3))
    return once(spark, "model_comparison", _churn_sources(spark, sf), build)


@query("train_rbf_svc")
def train_rbf_svc(spark, sf):
    """The radial-kernel support vector classifier: random Fourier features of the
    standardised mart in front of the linear one."""
    mart = _churn_mart(spark, sf)
    feats = churn_features(mart)
    s = split_hash(mart, ["customer_id"], 0.7, seed=123)
    st = EN.zscore_fit(s.where("split = 'train'"), feats).first().asDict()
    z, zc = EN.zscore_transform(s, st, feats), [f"{c}_z" for c in feats]
    gamma = KN.scale_gamma(z.where("split = 'train'"), zc)
    x = cut_lineage(KN.fourier_features(z, zc, gamma, keep=["split"]))
    m = T.make_classifier("svc", maxIter=50, regParam=1e-3).fit(x.where("split = 'train'"))
    pred = cut_lineage(T.scored(m, x.where("split = 'test'")))
    return T.evaluation(pred, "rbf_svc").drop("weighted_precision")


# the features of the training mart, in its order
MART_FEATURES = (
    ["n_subscription_rows", "avg_days_subscription", "avg_months_subscription", "sum_meals", "min_price", "max_price",
     "avg_price", "sum_price", "min_discount", "max_discount", "sum_discount"]
    + [f"{m}_{p}" for p in CH.PRODUCTS for m in ("sum_meals", "sum_price")]
    + [f"{m}_pay_{p}" for p in CH.PAYMENTS for m in ("sum_price", "sum_discount")]
    + [f"n_subscriptions_{y}" for y in CH.YEARS]
    + [f"{m}_{f}" for f in CH.FORMULAS for m in ("n_formula", "sum_duration", "avg_duration")]
    + ["customer_lifetime"] + [f"region_{r.replace(' ', '_')}" for r in CH.REGIONS]
    + [f"n_complaints_{e}" for e in CH.EVENT_TYPES])


def _long_mart_sql() -> str:
    """The churn mart as ``customer_id, label, c, v``: a row for every feature of a customer."""
    from .q_marts import _churn_sql
    cells = ", ".join(f"{{'c': '{c}', 'v': CAST({c} AS DOUBLE)}}" for c in MART_FEATURES)
    return (f"WITH mart AS ({_churn_sql()}), u AS (SELECT customer_id, label, unnest([{cells}]) AS s FROM mart), "
            "long AS (SELECT customer_id, label, s.c AS c, s.v AS v FROM u)")


@query("corr_matrix_mart", f"""{_long_mart_sql()}
SELECT a.c AS a, b.c AS b, CASE WHEN min(a.v) = max(a.v) OR min(b.v) = max(b.v) THEN NULL
       ELSE round(least(1.0, greatest(-1.0, corr(a.v, b.v))), 6) + 0.0 END AS corr
FROM long a JOIN long b USING (customer_id) GROUP BY a.c, b.c""")
def corr_matrix_mart(spark, sf):
    """Correlation of every two features of the churn mart, from one pass of co-moments."""
    m = CM.correlation_rows(_churn_mart(spark, sf), MART_FEATURES)
    return m.select("a", "b", (F.round("corr", 6) + 0.0).alias("corr"))


@query("pca_mart")
def pca_mart(spark, sf):
    """The five first principal components of the standardised mart, from the same co-moments."""
    return CM.project(_churn_mart(spark, sf), MART_FEATURES, 5, keep=["customer_id"])


_DONOR_OUT = {"donor_id", "campaign_amount", "label"}


def _donor_mart(spark, sf, **period):
    src = tables(spark, sf, "customer", "orders")
    return once(spark, f"donor_mart {sorted(period.items())}", src, lambda: D.donor_mart(*src, **period))


def _donor_steps(spark, sf):
    s = split_hash(_donor_mart(spark, sf), ["donor_id"], 0.7, seed=123)
    cands = [c for c in s.columns if c not in _DONOR_OUT | {"split"}]
    return s.where("split = 'train'"), s.where("split = 'test'"), cands


@query("stepwise_auc")
def stepwise_auc(spark, sf):
    """Forward selection over every feature of the donor mart, to the end: the
    logistic run, all candidates of a step fitted together.  (Any other model of
    ``make_classifier``: ``operators.train.stepwise_auc``, a fit for each candidate.)"""
    return ST.stepwise_logistic(*_donor_steps(spark, sf))


@query("stepwise_naive_bayes")
def stepwise_naive_bayes(spark, sf):
    """The same selection with Gaussian naive Bayes."""
    return ST.stepwise_naive_bayes(*_donor_steps(spark, sf))


def _campaigns(spark, sf):
    """The model of the 2000 campaign and both campaigns scored with it:
    ``campaign, donor_id, label, prediction, s``."""
    now = _donor_mart(spark, sf)
    after = _donor_mart(spark, sf, cutoff="2001-01-01", campaign_end="2002-01-01")
    feats = [c for c in now.columns if c not in _DONOR_OUT | {"zip_int"}]
    m = T.make_classifier("gbt", len(feats), 1, maxIter=20, maxDepth=3).fit(T.assembled(now, feats))
    both = [T.scored(m, T.assembled(d, feats), "donor_id").withColumn("campaign", F.lit(n))
            for n, d in (("training", now), ("next", after))]
    return cut_lineage(both[0].unionByName(both[1]))


@query("donor_campaign_scores")
def donor_campaign_scores(spark, sf):
    """Donors of the next campaign, likeliest first (ties by id)."""
    s = _campaigns(spark, sf).where("campaign = 'next'")
    return s.select("donor_id", F.col("s").alias("p_positive"), "prediction", "label").orderBy(F.desc("p_positive"), "donor_id")


@query("donor_campaign_auc")
def donor_campaign_auc(spark, sf):
    return EV.auc_by(_campaigns(spark, sf), "label", "s", "campaign")


@query("donor_campaign_roc")
def donor_campaign_roc(spark, sf):
    s = _campaigns(spark, sf)
    parts = [EV.roc_table(s.where(F.col("campaign") == n), "label", "s").withColumn("campaign", F.lit(n))
             for n in ("training", "next")]
    return parts[0].unionByName(parts[1])


def _two_periods(spark, sf):
    """(training mart, scoring mart, scaled columns, scaler, features that both have)."""
    train = _churn_mart(spark, sf)
    scoring = _churn_mart(spark, sf, as_of_date=CH.SCORING_AS_OF, after=CH.SCORING_FROM, years=CH.SCORING_YEARS)
    # calendar-year pivots differ between the two periods: score on the rest
    feats = [f for f in churn_features(train) if not f.startswith("n_subscriptions_")]
    return train, scoring, [f"{c}_z" for c in feats], EN.zscore_fit(train, feats).first().asDict(), feats


@query("score_customers")
def score_customers(spark, sf):
    """Fit on the training mart, score the customers of the scoring mart
    that are still active (label 0) with the training-set scaler, highest
    churn probability first."""
    train, scoring, zc, st, feats = _two_periods(spark, sf)
    m = T.make_classifier("lr", len(zc), maxIter=50).fit(T.assembled(EN.zscore_transform(train, st, feats), zc))
    current = scoring.where("label = 0").drop("label")
    cur = T.assembled(EN.zscore_transform(current, st, feats).withColumn("label", F.lit(0)), zc)
    return T.score(m, cur, "customer_id").select("customer_id", "p_positive", "prediction")


def _segments(df, columns, k=3, suffix="_w"):
    """Winsorised, scaled k-means; (rows with ``cluster``, centres in original units)."""
    w = EN.winsorize(df, columns, upper=0.01, suffix=suffix)
    wc = [f"{c}{suffix}" for c in columns]
    st = EN.zscore_fit(w, wc).first().asDict()
    zc = [f"{c}_z" for c in wc]
    rows, centres = T.kmeans_segments(EN.zscore_transform(w, st, wc), zc, k=k, seed=1)
    back = EN.zscore_inverse(centres.select("cluster", "size", *[F.col(f"`{c}`") for c in zc]),
                             st, wc, suffix="_z", out_suffix="_centre")
    return rows, back.select("cluster", "size", *[F.round(f"{c}_centre", 2).alias(f"{c}_centre") for c in wc])


# fixed values: the features of the segmentation
_BANK_SEGMENT = ["age", "age_group", "avg_salary", "days_since_acc_creation", "total_trans",
                 "mean_all_trans", "days_since_last_trans", "total_nbr_orders", "average_all_orders"]


@query("bank_segments")
def bank_segments(spark, sf):
    """k=3 on the winsorised, scaled bank mart; centres back in original units.  (The
    district's average salary is the mean balance of its clients.)"""
    from . import bank as B
    c, n, r, li, o = tables(spark, sf, "customer", "nation", "region", "lineitem", "orders")
    mart = B.bank_mart(c, n, r, li, o).join(B.segment_features(c, o), "account_id", "left")
    mart = cut_lineage(mart.select("account_id", *[F.col(c).cast("double").alias(c) for c in _BANK_SEGMENT])
                       .na.fill(0.0))
    return _segments(mart, _BANK_SEGMENT)[1]


PROFILE = ["n_subscription_rows", "customer_lifetime", "avg_days_subscription", "avg_months_subscription", "sum_meals",
           "avg_price", "sum_price", "sum_discount", "min_price", "max_price", "days_without_sub", "n_subscriptions_1995",
           "n_subscriptions_1996", "n_subscriptions_1997", "n_subscriptions_1998", "n_formula_F", "sum_duration_F",
           "n_formula_O", "sum_duration_O", "n_complaints_click", "n_complaints_error"]


# what churners are clustered on: the profile without what defines the label, in the scored period's years
CHURNER = [c for c in PROFILE if c != "days_without_sub" and not c.startswith("n_subscriptions_")] + [
    f"n_subscriptions_{y}" for y in CH.SCORING_YEARS]


@query("churner_segments")
def churner_segments(spark, sf):
    """k=3 on the customers of the second period that the model of the first predicts
    to churn; the averages of every cluster."""
    train, scoring, zc, st, feats = _two_periods(spark, sf)
    m = T.make_classifier("lr", len(zc), maxIter=50).fit(T.assembled(EN.zscore_transform(train, st, feats), zc))
    after = T.assembled(EN.zscore_transform(scoring, st, feats), zc)
    churners = cut_lineage(m.transform(after).where("prediction = 1").select("customer_id", *CHURNER))
    rows, _ = T.kmeans_segments(churners, CHURNER, k=3, seed=1)
    return T.cluster_profile(rows, "cluster", CHURNER)


def _profile_sql() -> str:
    from .q_marts import _churn_sql
    exact = lambda c: f"CAST(SUM(CAST({c} AS DECIMAL(28,6))) AS DOUBLE) / COUNT({c})"
    return (f"WITH mart AS ({_churn_sql()}) SELECT label AS cluster, COUNT(*) AS n, "
            + ", ".join(f"{exact(c)} AS avg_{c}" for c in PROFILE) + " FROM mart GROUP BY label")


@query("churner_profile", _profile_sql())
def churner_profile(spark, sf):
    """The profile's arithmetic, on the rule-based label as the cluster."""
    o, li, p, ev, c, n, r = tables(spark, sf, "orders", "lineitem", "part", "events", "customer",
                                   "nation", "region")
    mart = CH.churn_mart(o, li, p, ev, c, n, r).select(
        F.col("label").alias("cluster"), *[F.col(x).cast("decimal(28,6)").alias(x) for x in PROFILE])
    return T.cluster_profile(mart, "cluster", PROFILE)


_KM = ["total_price", "n_orders", "recency_days"]


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    (o,) = tables(spark, sf, "orders")
    g = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total_price"),
                                   F.count(F.lit(1)).alias("n_orders"),
                                   F.datediff(F.to_date(F.lit("2002-01-01")),
                                              F.to_date(F.max("o_orderdate"))).alias("recency_days"))
    return _segments(cut_lineage(g), _KM)[1]


@query("cluster_profile", """
SELECT o_orderpriority, COUNT(*) AS n,
  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / COUNT(o_totalprice) AS avg_price,
  CAST(SUM(CAST(o_orderstatus = 'F' AS INTEGER)) AS DOUBLE) / COUNT(*) AS avg_finished
FROM orders GROUP BY o_orderpriority""")
def cluster_profile(spark, sf):
    (o,) = tables(spark, sf, "orders")
    x = o.select("o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price"),
                 (F.col("o_orderstatus") == "F").cast("int").alias("finished"))
    return T.cluster_profile(x, "o_orderpriority", ["price", "finished"]) \
        .withColumnsRenamed({"avg_price": "avg_price", "avg_finished": "avg_finished"})


@query("churners_mart", """
WITH p AS (SELECT o_custkey, CASE WHEN date_diff('day', CAST(MAX(o_orderdate) AS DATE), DATE '1998-08-31') > 180
                                  THEN 1 ELSE 0 END AS prediction
           FROM orders WHERE o_orderdate <= DATE '1998-08-31' GROUP BY o_custkey)
SELECT c.c_custkey, c.c_mktsegment, c.c_acctbal, p.prediction
FROM customer c JOIN p ON c.c_custkey = p.o_custkey WHERE p.prediction = 1""")
def churners_mart(spark, sf):
    o, c = tables(spark, sf, "orders", "customer")
    lab = G.churn_label(o.where(F.col("o_orderdate") < F.to_date(F.lit("1998-09-01"))),
                        "o_custkey", "o_orderdate", "o_orderdate", "1998-08-31", 180)
    pred = lab.select(F.col("o_custkey").alias("c_custkey"), F.col("label").alias("prediction"))
    return c.select("c_custkey", "c_mktsegment", "c_acctbal").join(pred, "c_custkey") \
        .where("prediction = 1")


def _emb(spark, sf):
    (e,) = tables(spark, sf, "embeddings")
    return e.select("vec_id", "label", array_to_vector("embedding").alias("v"))


@query("vector_standardize", """
WITH x AS (SELECT vec_id, CAST(UNNEST(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS i
           FROM embeddings),
s AS (SELECT i, AVG(v) AS m, STDDEV_SAMP(v) AS sd FROM x GROUP BY i)
SELECT vec_id, list(round(CASE WHEN sd = 0 THEN 0.0 ELSE (v - m) / sd END, 6) ORDER BY i) AS standardized
FROM x JOIN s USING (i) GROUP BY vec_id""")
def vector_standardize(spark, sf):
    """``StandardScaler`` (centred, sample std) on the embedding vectors,
    returned as rounded arrays so it can be compared with SQL."""
    e = _emb(spark, sf)
    m = StandardScaler(inputCol="v", outputCol="s", withMean=True, withStd=True).fit(e)
    return m.transform(e).select(
        "vec_id", F.transform(vector_to_array("s"), lambda x: F.round(x, 6)).alias("standardized"))


@query("pca_project")
def pca_project(spark, sf):
    e = _emb(spark, sf)
    m = PCA(k=10, inputCol="v", outputCol="p").fit(e)
    return m.transform(e).select("vec_id", vector_to_array("p").alias("pca"))


@query("chi2_select", f"""{_long_mart_sql()},
r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) AS rn, count(*) OVER (PARTITION BY c) AS n FROM long WHERE v IS NOT NULL),
t AS (SELECT DISTINCT c, v AS t FROM r, (SELECT unnest(range(1, 10)) AS i) WHERE rn = (n * i + 9) // 10),
g AS (SELECT c, list(t) AS ts FROM t GROUP BY c),
b AS (SELECT long.c, label AS y, coalesce(len(list_filter(ts, lambda x: v > x)), -1) AS bin FROM long JOIN g ON long.c = g.c),
o AS (SELECT c, bin, y, CAST(count(*) AS DOUBLE) AS o FROM b GROUP BY ALL),
e AS (SELECT *, sum(o) OVER (PARTITION BY c, bin) AS rv, sum(o) OVER (PARTITION BY c, y) AS cy FROM o),
x AS (SELECT c AS feature, round(sum(o) * (sum(o * o / (rv * cy)) - 1), 6) AS chi2,
             CAST((count(DISTINCT bin) - 1) * (count(DISTINCT y) - 1) AS BIGINT) AS dof FROM e GROUP BY c),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY chi2 DESC, feature) AS INTEGER) AS rank FROM x)
SELECT feature, rank, chi2, dof FROM k WHERE rank <= 30""")
def chi2_select(spark, sf):
    """The 30 features of the churn mart that depend most on the label: chi-square over
    their deciles, as most are continuous (by the statistic, ties by name)."""
    return FT.chi2_top(_churn_mart(spark, sf), MART_FEATURES, "label", 30)


COUNT_FEATURES = ["n_subscription_rows", "n_subscriptions_1995", "n_subscriptions_1996",
                  "n_subscriptions_1997", "n_subscriptions_1998", "n_formula_F", "n_formula_O",
                  "n_complaints_click", "n_complaints_error", "n_complaints_purchase",
                  "n_complaints_signup", "n_complaints_view"]


@query("feature_steps_fit_transform")
def feature_steps_fit_transform(spark, sf):
    """assemble -> chi-square top 6 -> standardise -> PCA(3), fitted on the
    training split only and applied to the test split; the selected column
    names are returned with each row."""
    from ..operators.features import feature_pipeline, selected_names
    mart = _churn_mart(spark, sf).withColumn("label", F.col("label").cast("double"))
    mart = mart.select("customer_id", "label", *[F.col(x).cast("double").alias(x) for x in COUNT_FEATURES])
    s = split_hash(mart, ["customer_id"], 0.7, seed=123)
    model = feature_pipeline(COUNT_FEATURES, "label", n_top=6, pca_k=3).fit(s.where("split = 'train'"))
    names = ",".join(selected_names(model, COUNT_FEATURES))
    out = model.transform(s.where("split = 'test'"))
    return out.select("customer_id", vector_to_array("features").alias("features"),
                      F.lit(names).alias("selected"))


DONOR_SEGMENT_FEATURES = ["amt_all", "frequency_gifts", "recency_days", "Q4"]


@query("donor_segments")
def donor_segments(spark, sf):
    """k-means (k=5) on the scaled donor mart, then every feature described
    per segment in original units (count, mean, std, min, quartiles, max)."""
    c, o = tables(spark, sf, "customer", "orders")
    mart = cut_lineage(D.donor_mart(c, o))  # read by the fit, k-means and the profile
    st = EN.zscore_fit(mart, DONOR_SEGMENT_FEATURES).first().asDict()
    z = EN.zscore_transform(mart, st, DONOR_SEGMENT_FEATURES)
    assigned, _ = T.kmeans_segments(z, [f"{f}_z" for f in DONOR_SEGMENT_FEATURES], k=5, seed=1)
    assigned = cut_lineage(assigned)
    from ..operators.profile import describe_by_group
    return describe_by_group(assigned, "cluster", DONOR_SEGMENT_FEATURES)
