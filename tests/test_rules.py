"""Rules that hold at every size: no capped categories, no lost rows, no
values cut to a prefix, and an as-of rule that keeps the future out."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from martwright.functions import dates
from martwright.operators import aggregate as G
from martwright.operators import encode as EN
from martwright.operators import evaluate as EV
from martwright.operators import sampling as S
from martwright.operators.profile import describe
from martwright.operators.select import interpolated_quantiles
from martwright.plans import churn as CH


def test_infinite_values(spark):
    n = 50_000
    df = spark.range(n).selectExpr(f"case when id = 0 then double('-Infinity') when id >= {n - 5} then double('Infinity') "
                                   "else cast(id as double) end as x")
    got = interpolated_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0])
    assert got[("x", 0.0)] == -math.inf and got[("x", 1.0)] == math.inf
    assert got[("x", 0.5)] == (n - 1) / 2 and got[("x", 0.25)] == (n - 1) / 4
    rows = {(r.column, r.metric): r.value for r in describe(df).collect()}
    assert rows[("x", "p50")] == (n - 1) / 2 and rows[("x", "max")] == math.inf
    assert EN.winsor_caps(df, ["x"], 0.01)["x"] == n - int(0.01 * n) - 1


def test_winsor_caps_of_many_columns_at_once(spark):
    df = spark.range(1000).selectExpr("cast(id as double) a", "cast(id % 10 as double) b", "cast(null as double) c")
    assert EN.winsor_caps(df, ["a", "b", "c"], 0.05) == {"a": 949.0, "b": 9.0, "c": None}


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(100).selectExpr("id", "case when id < 10 then null when id < 40 then 1 else 0 end as y",
                                       "case when id % 2 = 0 then 1.0 else 0.0 end as p", "id / 100 as s")


def test_rows_without_a_label_are_kept(labelled):
    split = S.split_stratified(labelled, "y", ["id"], 0.7)
    got = {(r.y, r.split): r.n for r in split.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(None, "train"): 7, (None, "test"): 3, (1, "train"): 21, (1, "test"): 9, (0, "train"): 42, (0, "test"): 18}
    over = {r.y: r.n for r in S.oversample(labelled, "y", ["id"]).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert over == {None: 60, 1: 60, 0: 60}
    wp = EV.weighted_precision(labelled, "y", "p").first().weighted_precision
    assert abs(wp - (30 * 15 / 50 + 60 * 30 / 50) / 100) < 1e-12       # the ten without a label weigh, with precision 0
    groups = {r.y for r in EV.auc_by(labelled.withColumn("g", F.col("id") % 2), "g", "s", "y").collect()}
    assert groups == {None, 0, 1}


def test_copies_in_blocks(spark):
    df = spark.range(2501).selectExpr("id", "if(id = 0, 1, 0) as y")
    out = S.oversample(df, "y", ["id"], chunk=100).where("y = 1")
    assert sorted(r.copy for r in out.collect()) == list(range(1, 2501))


def test_whole_range_goes_to_train(labelled):
    assert S.split_hash(labelled, ["id"], 1.0).where("split = 'test'").count() == 0
    assert S.split_hash(labelled, ["id"], 0.0).where("split = 'train'").count() == 0


def test_dates_are_never_a_prefix(spark):
    df = spark.createDataFrame([("930101",), ("9301015",), ("50101",), ("93a101",), ("",), (None,)], "d string")
    got = [r.x for r in df.select(dates.parse_yymmdd("d").alias("x")).collect()]
    assert got == [date(1993, 1, 1), None, date(1905, 1, 1), None, None, None]


def test_names_that_render_alike(spark):
    df = spark.createDataFrame([(1, "A+", 1.0), (1, "A-", 2.0), (2, "A-", 4.0)], "k int, s string, v double")
    assert G.safe_names(["A+", "A-", "a", "B"]) == {"A+": "A", "A-": "A_2", "a": "a_3", "B": "B"}
    out = G.pivot_agg(df, "k", "s", [("sum", "v", "s")], values=["A+", "A-"])
    assert {(r.k, r.s_A, r.s_A_2) for r in out.collect()} == {(1, 1.0, 2.0), (2, None, 4.0)}
    assert EN.dummies(df, "s", ["A+", "A-"], prefix="s").select("s_A", "s_A_2").count() == 3


def test_pivots_of_many_values(spark):
    df = spark.range(3000).selectExpr("id % 3 as k", "cast(id % 600 as string) as p", "id % 7 as i", "cast(id as double) v")
    vals = G.discover_values(df, "p")
    assert len(G.pivot_agg(df, "k", "p", [("count_rows", None, "n")], values=vals).columns) == 601
    out = G.pivot_mean_of_groups(df, "k", "p", "i", "v", values=vals[:50])
    assert out.count() == 3 and len(out.columns) == 151


def _tables(spark):
    day = date(1998, 1, 1)
    orders = [(1, 10, "F", 1.0, day, "1-URGENT"), (2, 10, "F", 1.0, day, "1-URGENT"), (3, 10, "F", 1.0, day, "1-URGENT"),
              (4, 10, "F", 1.0, date(1998, 8, 30), "1-URGENT"), (5, 20, "F", 1.0, date(1997, 1, 1), "2-HIGH"),
              (6, 30, "O", 1.0, date(1998, 8, 1), "5-LOW"), (7, 10, "F", 1.0, day, "unknown")]
    lines = [(2, 1, 1.0, 10.0, 0.1, "R", day), (3, 1, 2.0, 10.0, 0.1, "R", day), (3, 1, 3.0, 10.0, 0.1, "R", day),
             (3, 1, 4.0, 10.0, 0.1, "N", day), (3, 1, 5.0, 99.0, 0.1, "R", date(1998, 9, 1)), (5, 9, 7.0, 5.0, 0.0, "N", day)]
    events = [(1, date(2024, 1, 15), 10, "click"), (2, date(2024, 1, 16), 10, "click")]
    return dict(
        orders=spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                             "o_orderdate date, o_orderpriority string").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")),
        lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, "
                                              "l_discount double, l_returnflag string, l_shipdate date").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp")),
        part=spark.createDataFrame([(1, "ECONOMY", 3)], "p_partkey long, p_type string, p_size int"),
        events=spark.createDataFrame(events, "event_id long, ts date, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")),
        customer=spark.createDataFrame([(10, 1), (20, 1)], "c_custkey long, c_nationkey long"),
        nation=spark.createDataFrame([(1, "N", 1)], "n_nationkey long, n_name string, n_regionkey long"),
        region=spark.createDataFrame([(1, "ASIA")], "r_regionkey long, r_name string"))


def test_churn_mart_subscriptions_with_none_one_and_three_deliveries(spark):
    got = {r.customer_id: r for r in CH.churn_mart(**_tables(spark)).collect()}
    a = got[10]
    # 1: no delivery, 2: one, 3: three by the cut; 4 ends after it, 7 has no formula
    assert a.n_subscription_rows == 5 and a.sum_meals == 10.0 and a.max_price == 10.0
    assert a.last_end == date(1998, 1, 31) and a.label == 1 and a.n_complaints_click == 1 and a.region_ASIA == 1
    assert a.n_formula_F == 5 and a.sum_duration_F == 5
    assert got[20].n_subscription_rows == 1 and got[20].sum_meals == 7.0      # a product that is not known stays
    assert 30 not in got
    later = {r.customer_id: r for r in CH.churn_mart(**_tables(spark), as_of_date=CH.SCORING_AS_OF, after=CH.SCORING_FROM).collect()}
    assert set(later) == {10, 30} and later[10].n_complaints_click == 1 and later[10].n_subscription_rows == 1


def test_churn_mart_does_not_see_the_future(spark, sf_dir):
    """Rows after the cut may be anything: the training mart stays the same."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    t = {n: read(n) for n in ("orders", "lineitem", "part", "events", "customer", "nation", "region")}
    cut = F.to_date(F.lit(CH.AS_OF))
    end = F.date_add(F.to_date("o_orderdate"), F.lit(30))
    spoilt = dict(t)
    spoilt["lineitem"] = t["lineitem"].withColumn("l_extendedprice", F.when(F.to_date("l_shipdate") > cut, 1e6).otherwise(F.col("l_extendedprice")))
    spoilt["events"] = t["events"].withColumn("event_type", F.when(F.to_date("ts") > F.to_date(F.lit(CH.COMPLAINTS_AS_OF)), "error").otherwise(F.col("event_type")))
    spoilt["orders"] = t["orders"].withColumn("o_orderstatus", F.when(end > cut, "P").otherwise(F.col("o_orderstatus")))
    rows = [sorted(map(tuple, CH.churn_mart(**x).collect())) for x in (t, spoilt)]
    assert rows[0] == rows[1]
    labels = [r.label for r in CH.churn_mart(**t).select("label").collect()]
    assert 0.05 < sum(labels) / len(labels) < 0.95
    assert CH.churn_mart(**t).where("days_without_sub < 0 OR last_end > date'1998-08-31'").count() == 0
