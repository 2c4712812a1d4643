"""Checked CSV reads, stored marts, stored profiles."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

import __spark_entry__ as entry
from martwright.operators import sketches as SK
from martwright.sources.checked import CORRUPT, read_csv_checked, reject_counts
from martwright.sources.marts import read_mart, save_mart

SCHEMA = StructType([StructField("id", LongType()), StructField("price", DoubleType()), StructField("note", StringType())])


def test_rows_and_rejects_add_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,price,note\n1,2.5,x\n2,,"a, quoted ""note"""\n3,4\n4,5,y,more\nfive,6,z\n,,\n7,oops,w\n8,1e3,é\n')
    good, rejects = read_csv_checked(spark, str(tmp_path), SCHEMA)
    assert sorted(map(tuple, good.collect()), key=repr) == sorted(
        [(1, 2.5, "x"), (2, None, 'a, quoted "note"'), (None, None, None), (8, 1000.0, "é")], key=repr)
    assert {r.reason: r.n for r in reject_counts(rejects).collect()} == {"short": 1, "long": 1, "type": 2}
    assert {r.line for r in rejects.collect()} == {"3,4", "4,5,y,more", "five,6,z", "7,oops,w"} and good.columns == SCHEMA.fieldNames()


def test_semicolons_and_clashing_schema(spark, tmp_path):
    (tmp_path / "b.csv").write_text("1;2,5;x\n2;2.5;y\n")
    good, rejects = read_csv_checked(spark, str(tmp_path), SCHEMA, sep=";", header=False)
    assert [r.id for r in good.collect()] == [2] and [r.reason for r in rejects.collect()] == ["type"]
    with pytest.raises(ValueError):
        read_csv_checked(spark, str(tmp_path), StructType([StructField(CORRUPT, LongType())]))


def test_rewriting_one_date_leaves_the_others_and_joins_without_exchange(spark, tmp_path):
    mart, scores = (f"t_{uuid.uuid4().hex}" for _ in range(2))
    df = spark.range(200).selectExpr("id as k", "id * 2 as v")
    save_mart(df, mart, "k", "2020-01-01", str(tmp_path / "m"), buckets=4)
    save_mart(df.where("k < 50"), mart, "k", "2021-01-01", str(tmp_path / "m"), buckets=4)
    save_mart(df.where("k < 10"), mart, "k", "2020-01-01", str(tmp_path / "m"), buckets=4)
    assert {(str(r.as_of), r.n) for r in spark.table(mart).groupBy("as_of").agg(F.count(F.lit(1)).alias("n")).collect()} == {
        ("2020-01-01", 10), ("2021-01-01", 50)}
    save_mart(df.selectExpr("k", "v / 7 as score"), scores, "k", "2021-01-01", str(tmp_path / "s"), buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = read_mart(spark, mart, "2021-01-01").join(read_mart(spark, scores, "2021-01-01"), "k")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 50 and "Exchange" not in plan and "PartitionFilters: [isnotnull(as_of" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {mart}")
        spark.sql(f"DROP TABLE {scores}")


def test_merged_profiles_describe_the_whole(spark):
    rnd = random.Random(3)
    rows = [(i, i % 12, rnd.lognormvariate(0, 2) if i % 9 else None, float(i % 3)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, month int, a double, b double")
    stored = SK.profiles(df, {"month": F.col("month")}, ["a", "b"], k=400)
    assert stored.count() == 24
    probs = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 99)}
    for part, keep in ((stored, lambda m: True), (stored.where("month < 5"), lambda m: m < 5)):
        got = {r["column"]: r for r in SK.describe_profiles(part, probs).collect()}
        v = sorted(r[2] for r in rows if r[2] is not None and keep(r[1]))
        assert got["a"]["count"] == len(v) and got["a"]["min"] == v[0] and got["a"]["max"] == v[-1]
        assert abs(got["a"]["mean"] - sum(v) / len(v)) < 1e-9 * abs(got["a"]["mean"]) + 1e-12
        for name, p in probs.items():
            below = sum(x <= got["a"][name] for x in v) / len(v)
            assert abs(below - p) <= SK.rank_error(400) + 1 / len(v), (name, below)
    by = SK.describe_profiles(stored.withColumn("half", F.col("month") < 6), probs, ["half"])
    assert by.count() == 4
    assert SK.describe_profiles(SK.profiles(df.limit(0), {"month": F.col("month")}, ["a"]), probs).count() == 0


@pytest.mark.parametrize("name", ["csv_quarantine", "mart_stored", "describe_stored"])
def test_queries_have_rows(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 1
