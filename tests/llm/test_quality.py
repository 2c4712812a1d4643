import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    labels = queries.table(spark, BIG, "labels").filter(~toxicity.held_out())
    return quality.fit(queries.table(spark, BIG, "documents"), labels)


def test_held_out_rows(spark):
    labels = queries.table(spark, BIG, "labels")
    got = queries.op7(spark, BIG).join(labels, "doc_id").filter("held_out").collect()
    wrong = sum(r.keep != (r.quality == 1) for r in got)
    assert wrong <= 0.01 * len(got) and sum(r.quality == 1 and not r.keep for r in got) <= 0.005 * len(got)


def nested(paths):
    """Variances (noise, path, host) of the nested random-effects model, from its
    expected sums of squares as matrices: E[y' A y] = sum of variance x trace(A Z Z')."""
    y = np.concatenate([np.array(x) for x in paths.values()])
    names = [k for k, x in paths.items() for _ in x]
    one = lambda keys: (np.array(sorted(set(keys)))[None, :] == np.array(keys)[:, None]).astype(float)
    zp, zh, z0 = one(["|".join(map(str, k)) for k in names]), one([str(k[0]) for k in names]), np.ones((len(y), 1))
    flat = lambda z: z @ np.diag(1 / z.sum(0)) @ z.T  # noqa: E731  averages within groups
    noise, path, host = np.eye(len(y)) - flat(zp), flat(zp) - flat(zh), flat(zh) - flat(z0)
    trace = lambda a, z: np.trace(a @ z @ z.T)
    v0 = max(y @ noise @ y / np.trace(noise), 1e-9)

    def level(a, z, below):
        over, free = y @ a @ y - below, np.trace(a)
        return over / trace(a, z) if over > 3 * below * (2 / free) ** 0.5 else 0.0
    v1 = level(path, zp, v0 * np.trace(path))
    return v0, v1, level(host, zh, v0 * np.trace(host) + v1 * trace(host, zp))


def sums(spark, paths):
    rows = [(h, float(len(x)), float(sum(x)), float(sum(v * v for v in x))) for (h, _), x in paths.items()]
    n, s = F.col("n"), F.col("s")
    return spark.createDataFrame(rows, "_host string, n double, s double, q double").groupBy("_host").agg(
        F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("q").alias("q"), F.count(F.lit(1)).alias("paths"),
        F.sum(s * s / n).alias("b"), F.sum(n * n).alias("nn"))


@pytest.mark.parametrize("path_effect", [0.0, 0.1])
def test_variances_of_the_nested_model(spark, path_effect):
    """20 hosts of two kinds, five paths of 1 to 40 documents each."""
    rng = np.random.default_rng(3)
    paths = {}
    for h in range(20):
        for k in range(5):
            at = (0.3 if h % 2 else 0.7) + path_effect * rng.standard_normal()
            paths[f"h{h}", k] = list(at + 0.05 * rng.standard_normal(int(rng.integers(1, 41))))
    got = quality.variances(sums(spark, paths))
    assert np.allclose([got.within, got.path, got.host], nested(paths))
    assert abs(got.within ** 0.5 - 0.05) < 0.01 and abs(got.host ** 0.5 - 0.2) < 0.08
    if path_effect:
        assert abs(got.path ** 0.5 - 0.1) < 0.03 and got.path_strength() < 1
    else:
        assert got.path_strength() > 1_000  # a path says nothing that its host does not


def test_variances_of_little(spark):
    for paths in ({("a", 0): [0.5]}, {("a", 0): [0.5, 0.5], ("b", 0): [0.5, 0.5]}):
        got = quality.variances(sums(spark, paths))
        assert got.path_strength() == 1e6 and got.host == 0


def test_posteriors_against_plain_arithmetic(spark, model):
    """Shrinkage recomputed from the evidence column, host by host."""
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    rows = quality.score(docs, model, F.col("source"), F.concat_ws("/", "source", "lang")).join(
        docs.select("doc_id", "source", "lang"), "doc_id").collect()
    p = {r.doc_id: r.evidence for r in rows}

    hosts, paths = {}, {}
    for r in rows:
        hosts.setdefault(r.source, []).append(p[r.doc_id])
        paths.setdefault((r.source, r.lang), []).append(p[r.doc_id])
    prior = np.mean(list(p.values()))
    v = nested(paths)
    kp = min(max(v[0] / v[1], 0.5), 1e6) if v[1] > 0 else 1e6
    for r in rows:
        h, l = hosts[r.source], paths[r.source, r.lang]
        crowd = sum(len(x) ** 2 for (o, _), x in paths.items() if o == r.source) / len(h)
        kh = min(max((v[0] + v[1] * crowd) / v[2], 0.5), 1e6) if v[2] > 0 else 1e6
        assert np.isclose(r.host_posterior, (sum(h) + kh * prior) / (len(h) + kh))
        at_host = (sum(h) - r.evidence + kh * prior) / (len(h) - 1 + kh)
        at_path = (sum(l) - r.evidence + kp * at_host) / (len(l) - 1 + kp)
        assert np.isclose(r.path_posterior, at_path)
        e = min(max(r.evidence, 1e-9), 1 - 1e-9)
        z = np.log(e / (1 - e)) + np.log(at_path / (1 - at_path)) - np.log(prior / (1 - prior))
        assert np.isclose(r.score, 1 / (1 + np.exp(-z)), atol=1e-9) and r.keep == (r.score >= 0.5)


def test_bad_host_pulls_down_and_sparse_host_hardly(spark, model):
    good = "Er th onand the of and there, ond the erst inand. Th of an the here is and.\n" * 3
    bad = " ".join("word###" for _ in range(60))
    rows = [(i, bad if i % 10 else good, "bad") for i in range(400)] + [(1000 + i, good, "fine") for i in range(400)] + [(5000, good, "once")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = {r.doc_id: r for r in quality.score(df, model, F.col("host"), F.col("host")).collect()}
    assert got[0].score < got[5000].score < got[1000].score
    prior = sum(r.evidence for r in got.values()) / len(got)
    assert abs(got[5000].path_posterior - prior) < 0.05


def test_odd_rows(odd, empty, model):
    rows = quality.score(odd, model, F.col("source"), F.col("lang")).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model, F.col("source"), F.col("lang")).count() == 0
    assert len(quality.features("")) == len(quality.features("a b\n" * 9)) == quality.FEATURES


def test_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    w, b = quality.fit(odd, none)
    assert not any(w) and b == 0.0
