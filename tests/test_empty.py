"""Operators on empty inputs return empty / null results instead of failing."""

from pyspark.sql import functions as F

from martwright.operators import aggregate as G
from martwright.operators import encode as EN
from martwright.operators import evaluate as EV
from martwright.operators import profile as P
from martwright.operators import sampling as S
from martwright.operators.ranking import exact_quantiles, global_rank


def _empty(spark):
    return spark.createDataFrame([], "id int, g string, y int, s double")


def test_metrics_on_empty(spark):
    e = _empty(spark)
    assert EV.auc(e, "y", "s").first()[0] is None
    assert EV.roc_table(e, "y", "s").count() == 0
    assert EV.confusion_matrix(e, "y", (F.col("s") > 0).cast("int")).first().asDict() == {"tp": 0, "fp": 0, "tn": 0, "fn": 0}
    assert EV.gains_by_decile(e, "y", "s", ["id"]).count() == 0


def test_profiles_on_empty(spark):
    e = _empty(spark)
    d = {(r.column, r.metric): r.value for r in P.describe(e, ["s"]).collect()}
    assert d[("s", "count")] == 0.0 and d[("s", "p50")] is None
    assert P.describe_by_group(e, "g", ["s"]).count() == 0
    assert P.class_balance(e, "y").count() == 0


def test_encoders_and_samplers_on_empty(spark):
    e = _empty(spark)
    assert EN.winsorize(e, ["s"]).count() == 0
    assert EN.kth_smallest(e, "s", 1) is None
    assert S.split_stratified(e, "g", ["id"]).count() == 0
    assert S.oversample(e, "g", ["id"]).count() == 0
    assert global_rank(e, [("id", False)]).count() == 0
    assert exact_quantiles(e, "s", [0.5], group="g").count() == 0
    assert G.pivot_agg(e, "id", "g", [("sum", "s", "t")], values=["a"]).count() == 0


def test_discovery_on_empty(spark):
    e = _empty(spark)
    assert G.pivot_agg(e, "id", "g", [("sum", "s", "t")], G.discover_values(e, "g")).columns == ["id"]
    assert EN.dummies(e, "g", G.discover_values(e, "g")).columns == ["id", "y", "s"]
    assert EN.string_index(e, "g").count() == 0
