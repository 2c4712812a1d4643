"""Operator properties and brute-force checks on literal fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from martwright.operators import aggregate as G
from martwright.operators import encode as EN
from martwright.operators import evaluate as EV
from martwright.operators import sampling as S
from martwright.operators import select as SEL
from martwright.operators.joins import build_mart
from martwright.operators.ranking import global_rank, prefix_sums, rank_within


def test_kth_smallest_matches_sort_with_hot_value(spark, monkeypatch):
    monkeypatch.setattr(SEL, "ACCURACY", 50)  # brackets, not whole ranges
    rnd = random.Random(7)
    vals = [rnd.uniform(-1000, 1000) for _ in range(3000)] + [42.0] * 1500  # a third is one value
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    srt = sorted(vals)
    for k in (1, 1000, 2500, 3500, len(vals)):
        assert EN.kth_smallest(df, "x", k) == srt[k - 1]


def test_winsorize_cap_rule_and_idempotent(spark):
    vals = list(range(1, 1001))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    w = EN.winsorize(df, ["x"], upper=0.01)
    cap = w.agg(F.max("x_w")).first()[0]
    assert cap == float(1000 - 10)  # rank n - floor(0.01 n)
    w2 = EN.winsorize(w.select(F.col("x_w").alias("x")), ["x"], upper=0.0)
    assert w2.agg(F.max("x_w")).first()[0] <= cap


def test_zscore_roundtrip_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (8.0, 5.0)], "a double, c double")
    st = EN.zscore_fit(df, ["a", "c"]).first().asDict()
    assert st["a_std"] == pytest.approx(((1 - 4) ** 2 + (3 - 4) ** 2 + (8 - 4) ** 2) ** 0.5 / 3 ** 0.5)
    z = EN.zscore_transform(df, st, ["a", "c"])
    assert [r.c_z for r in z.collect()] == [0.0, 0.0, 0.0]
    back = EN.zscore_inverse(z, st, ["a"]).collect()
    assert [round(r.a_orig, 9) for r in back] == [1.0, 3.0, 8.0]


def test_dummies_sum_to_one(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "g string")
    d = EN.dummies(df, "g", values=["a", "b", "c"], prefix="g")
    sums = [sum(r) for r in d.collect()]
    assert sums == [1, 1, 1, 0]
    d1 = EN.dummies(df, "g", values=["a", "b", "c"], prefix="g", drop_first=True)
    assert d1.columns == ["g_b", "g_c"]


def test_pivot_mean_of_groups(spark):
    # account 1, operation X: k_symbol p has 2 rows, q has 1 row
    rows = [(1, "X", "p", 10.0), (1, "X", "p", 20.0), (1, "X", "q", 40.0), (1, "Y", "p", 5.0)]
    df = spark.createDataFrame(rows, "k int, op string, ks string, amt double")
    r = G.pivot_mean_of_groups(df, "k", "op", "ks", "amt", values=["X", "Y"]).first()
    assert r.count_X == 1.5          # mean of group counts (2, 1), not 3
    assert r.sum_X == 35.0           # mean of group sums (30, 40)
    assert r.mean_X == 27.5          # mean of group means (15, 40)
    s = G.pivot_mean_of_groups(df, "k", "op", "ks", "amt", values=["X"], combine="sum").first()
    assert s.count_X == 3 and s.sum_X == 70.0


def test_trailing_windows_open_bounds(spark):
    import datetime as dt
    rows = [(1, dt.date(2011, 12, 17), 1.0), (1, dt.date(2011, 12, 18), 2.0),
            (1, dt.date(2012, 12, 16), 4.0), (1, dt.date(2012, 12, 17), 8.0),
            (2, dt.date(1995, 1, 17), 16.0), (3, dt.date(2000, 1, 1), 32.0)]
    df = spark.createDataFrame(rows, "k int, d date, a double")
    wins = {"w1": "2011-12-17", "w_all": "1995-01-17"}
    out = {r.k: r for r in G.trailing_window_sums(df, "k", "d", "a", "2012-12-17", wins).collect()}
    assert out[1].w1 == 6.0 and out[1].w_all == 7.0   # both ends open
    assert 2 not in out                                # only on the lower bound: outside the base
    assert out[3].w1 is None and out[3].w_all == 32.0


def test_build_mart_keeps_base_rows_and_fills(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    f1 = spark.createDataFrame([(1, 5.0)], "k int, x double")
    f2 = spark.createDataFrame([(2, "s")], "k int, s string")
    m = build_mart(base, [(f1, "k"), (f2, "k")], fill=0, fanout="reject")
    rows = sorted(m.collect())
    assert len(rows) == 3 and rows[1].x == 0.0 and rows[0].s is None
    dup = spark.createDataFrame([(1, 1.0), (1, 2.0)], "k int, y double")
    with pytest.raises(ValueError):
        build_mart(base, [(dup, "k")], fanout="reject")


def test_prefix_sums_and_rank_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 2, 3]) if i % 3 else 7, rnd.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g int, v int")
    ps = {r.id: r.cum_v for r in prefix_sums(df, [("g", False), ("id", False)], ["v"], n_ranges=5).collect()}
    acc, exp = 0, {}
    for i, g, v in sorted(rows, key=lambda t: (t[1], t[0])):
        acc += v
        exp[i] = acc
    assert ps == exp
    rk = {r.id: r.rank for r in global_rank(df, [("v", True), ("id", False)], n_ranges=3).collect()}
    exp_rank = {t[0]: i + 1 for i, t in enumerate(sorted(rows, key=lambda t: (-t[2], t[0])))}
    assert rk == exp_rank
    rw = {r.id: r.rank for r in rank_within(df, "g", [("id", False)], n_ranges=4).collect()}
    for g in {t[1] for t in rows}:
        ids = sorted(t[0] for t in rows if t[1] == g)
        assert [rw[i] for i in ids] == list(range(1, len(ids) + 1))


def test_auc_symmetry_and_ties(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double")
    a = EV.auc(df, "y", "s").first()[0]
    b = EV.auc(df.withColumn("s", -F.col("s")), "y", "s").first()[0]
    assert a + b == pytest.approx(1.0)
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute)


def test_splits_disjoint_complete_and_stratified(spark):
    df = spark.createDataFrame([(i, "a" if i < 300 else "b") for i in range(1000)], "id int, c string")
    s = S.split_hash(df, ["id"], 0.7, seed=123)
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000
    again = {r.id: r.split for r in S.split_hash(df.repartition(7), ["id"], 0.7, seed=123).collect()}
    assert again == {r.id: r.split for r in s.collect()}   # independent of partitioning
    st = S.split_stratified(df, "c", ["id"], 0.7).groupBy("c", "split").count().collect()
    got = {(r.c, r.split): r["count"] for r in st}
    assert got[("a", "train")] == 210 and got[("b", "train")] == 490


def test_oversample_equal_classes(spark):
    df = spark.createDataFrame([(i, "min" if i < 30 else "maj") for i in range(130)], "id int, c string")
    o = S.oversample(df, "c", ["id"])
    cnt = {r.c: r["count"] for r in o.groupBy("c").count().collect()}
    assert cnt == {"min": 100, "maj": 100}
    per_id = o.where("c = 'min'").groupBy("id").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per_id) == (3, 4)


def test_gains_ntile_matches_sql_ntile(spark):
    from martwright.operators.ranking import ntile_from_rank
    df = spark.range(1, 24).select(F.col("id").alias("r"))
    got = [r.t for r in df.select("r", ntile_from_rank("r", F.lit(23), 10).alias("t")).orderBy("r").collect()]
    exp = [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9, 10, 10]
    assert got == exp


def test_exact_quantiles_hot_group_matches_percentile(spark):
    from martwright.operators.ranking import exact_quantiles
    rnd = random.Random(21)
    rows = [("hot", 3.0)] * 600 + [("hot", float(rnd.randint(0, 99))) for _ in range(300)] + \
           [("cold", float(x)) for x in (5, 1, 9, 7)] + [("one", 2.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.p): r.quantile for r in exact_quantiles(df, "v", probs, group="g", n_ranges=6).collect()}
    ref = df.groupBy("g").agg(*[F.percentile("v", p).alias(f"q{i}") for i, p in enumerate(probs)]).collect()
    for r in ref:
        for i, p in enumerate(probs):
            assert got[(r.g, p)] == r[f"q{i}"], (r.g, p)


def test_replace_in_rows_only_matching(spark):
    from martwright.operators.columns import replace_in_rows
    df = spark.createDataFrame([(1, "U", "U"), (2, "F", "U"), (3, None, "U")], "id int, g string, other string")
    out = sorted(replace_in_rows(df, "g = 'U'", {"U": "NA"}).collect())
    assert [tuple(r) for r in out] == [(1, "NA", "NA"), (2, "F", "U"), (3, None, "U")]


def test_bank_mart_one_row_per_client(spark, sf_dir):
    from martwright.plans import bank as BK
    from martwright.plans.catalog import tables
    c, n, r, li, o = tables(spark, sf_dir, "customer", "nation", "region", "lineitem", "orders")
    m = BK.bank_mart(c, n, r, li, o)
    assert m.count() == c.count()
    assert m.select("account_id").distinct().count() == c.count()
    loans = [x for x in m.columns if x.startswith("loan_") and x != "loan_days"]
    assert loans and m.where(" + ".join(loans) + " != 1").count() == 0   # one status per account


def test_string_index_frequency_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",), (None,)], "s string")
    got = {r.s: r.s_index for r in EN.string_index(df, "s").collect()}
    assert got == {"a": 0.0, "b": 1.0, "c": 2.0, None: None}   # ties by value


def test_describe_exact_and_approx_agree_on_small_data(spark):
    from martwright.operators.profile import describe
    df = spark.createDataFrame([(float(i),) for i in range(1, 102)], "x double")
    ex = {r.metric: r.value for r in describe(df, ["x"]).collect()}
    ap = {r.metric: r.value for r in describe(df, ["x"], exact=False).collect()}
    assert ex["p50"] == 51.0 and ex["p25"] == 26.0 and ex["p75"] == 76.0
    assert set(ex) == set(ap) and abs(ap["p50"] - 51.0) <= 1.0


def test_auc_by_group_matches_single_auc(spark):
    rnd = random.Random(13)
    rows = [(g, rnd.randint(0, 1), float(rnd.randint(0, 20))) for g in ("a", "b", "c") for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    by = {r.g: r.auc for r in EV.auc_by(df, "y", "s", "g").collect()}
    for g in ("a", "b", "c"):
        single = EV.auc(df.where(F.col("g") == g), "y", "s").first()[0]
        assert by[g] == pytest.approx(single, abs=1e-12)


def test_oversample_chunked_copies(spark):
    df = spark.createDataFrame([(i, "min" if i < 3 else "maj") for i in range(3 + 2500)], "id int, c string")
    o = S.oversample(df, "c", ["id"], chunk=100)
    cnt = {r.c: r["count"] for r in o.groupBy("c").count().collect()}
    assert cnt == {"min": 2500, "maj": 2500}
    per = {r.id: r["count"] for r in o.where("c = 'min'").groupBy("id").count().collect()}
    assert sorted(per.values()) == [833, 833, 834]
    assert o.where("c = 'min'").select("id", "copy").distinct().count() == 2500   # copy ids unique per row


def test_select_ranks_many_targets_matches_sort(spark, monkeypatch):
    monkeypatch.setattr(SEL, "ACCURACY", 50)
    from martwright.operators.select import interpolated_quantiles, select_ranks
    rnd = random.Random(17)
    rows = [(rnd.uniform(-5, 5), 3.0 if i % 3 == 0 else float(rnd.randint(0, 40))) for i in range(6000)]
    df = spark.createDataFrame(rows, "a double, b double")
    ranks = {"a": [1, 77, 3000, 6000], "b": [1, 2000, 2001, 4500, 6000]}
    got = select_ranks(df, ranks)
    for c, idx in (("a", 0), ("b", 1)):
        srt = sorted(r[idx] for r in rows)
        for k in ranks[c]:
            assert got[(c, k)] == srt[k - 1]
    q = interpolated_quantiles(df, ["a", "b"], [0.1, 0.5, 0.99])
    ref = df.agg(*[F.percentile(c, p).alias(f"{c}{p}") for c in "ab" for p in (0.1, 0.5, 0.99)]).first()
    assert all(q[(c, p)] == ref[f"{c}{p}"] for c in "ab" for p in (0.1, 0.5, 0.99))


def test_brackets_too_narrow_are_widened(spark):
    vals = [float(i % 997) for i in range(40_000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = SEL.ranked_values(df, {"x": [("m", 0.2, lambda n: F.lit(20_000))]}).first()   # the share named is wrong
    assert got.value == sorted(vals)[19_999]


def test_whole_numbers_beyond_doubles(spark):
    big = 2 ** 60
    df = spark.range(30_000).selectExpr(f"{big}L + id as x")
    got = SEL.ranked_values(df, {"x": [("m", 0.5, lambda n: F.lit(15_001))]}).first()
    assert got.value == float(big + 15_000)


def test_describe_by_group_null_group(spark, monkeypatch):
    from martwright.operators.profile import describe_by_group
    rows = [("g1", float(i)) for i in range(11)] + [(None, float(i)) for i in (5, 1, 3)]
    df = spark.createDataFrame(rows, "g string, a double")
    for accuracy in (10_000, 5):   # whole ranges, brackets
        monkeypatch.setattr(SEL, "ACCURACY", accuracy)
        got = {r.g: (r.p25, r.p50, r.p75, r["count"]) for r in describe_by_group(df, "g", ["a"]).collect()}
        assert got["g1"] == (2.5, 5.0, 7.5, 11.0)
        assert got[None] == (2.0, 3.0, 4.0, 3.0)


def test_dummies_unseen_and_empty_category(spark):
    train = spark.createDataFrame([("a",), ("b",)], "g string")
    values = G.discover_values(train, "g")
    test = spark.createDataFrame([("a",), ("zzz",), ("",), (None,)], "g string")
    rows = [tuple(r) for r in EN.dummies(test, "g", values=values, prefix="g").collect()]
    assert rows == [(1, 0), (0, 0), (0, 0), (0, 0)]          # unseen, empty, null -> all 0
    e = EN.dummies(test, "g", G.discover_values(test, "g"), prefix="g")  # discovered: '' becomes 'blank'
    assert e.columns == ["g_blank", "g_a", "g_zzz"]
