from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from martwright.llm import queries, toxicity
from martwright.llm.toxicity import (DECAY, LENGTH, SPAN, ToxicityModel, forms, kernel, sentences, squared_hinge,
                                     subsequences, tokens, windows)

BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return queries.toxicity_model(queries.table(spark, BIG, "documents"), queries.table(spark, BIG, "labels"))


def plain_kernel(a, b):
    def counts(w):
        w, out = "\x02" + w + "\x03", {}
        norm = 0.0
        for at in combinations(range(len(w)), LENGTH):
            if at[-1] - at[0] < SPAN:
                s = DECAY ** (at[-1] - at[0] + 1)
                key = "".join(w[i] for i in at)
                out[key] = out.get(key, 0) + s
                norm += s * s
        return {x: v / norm ** 0.5 for x, v in out.items()}
    x, y = counts(a), counts(b)
    return sum(v * y.get(t, 0) for t, v in x.items())


def test_kernel_against_plain_sums():
    a, b = ["idiot", "table", "", "x", "réêou", "ab" * 9], ["idiot", "idxiot", "stuff", "ii"]
    want = np.array([[plain_kernel(x, y) for y in b] for x in a])
    assert np.allclose(kernel(a, b), want)
    assert kernel(["idiot"], ["idxiot"])[0, 0] > 3 * kernel(["idiot"], ["stuff"])[0, 0]


def test_collapsed_weights_equal_the_landmark_expansion(model):
    words = ["idiot", "moron", "the", "somewhere", "réeuxan"]
    d = model.decide(words)
    assert np.isfinite(d).all() and d[0] > d[2] and len(model.landmarks) <= sum(toxicity.LANDMARKS)
    idx, keys, values = subsequences(words)
    table = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    want = np.full(len(words), model.intercept)
    for i, k, v in zip(idx, keys.tolist(), values, strict=True):
        want[i] += table.get(k, 0.0) * v
    assert np.allclose(d, want, atol=1e-5)
    more = ["", "a", "ab", "x" * 40, "\U0001F600é", "i-d-i-o-t", "ßüäö"]
    assert model._direct() is not None
    assert np.allclose(model.decide(words + more), model._decide_hashed(words + more), atol=1e-5)


def test_held_out_rows(spark, model):
    docs, labels = queries.table(spark, BIG, "documents"), queries.table(spark, BIG, "labels")
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    hit = sum(r.predicted and r.toxic for r in got)
    false = sum(r.predicted and not r.toxic for r in got)
    assert hit >= 127 and sum(r.toxic for r in got) == 144 and false <= 0.002 * sum(not r.toxic for r in got)
    s, y = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    order = s.argsort().argsort() + 1
    auc = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.95 and ((s >= 0) & (s <= 1)).all()


def test_spoilt_insults_are_caught(model):
    clean = "the ththand of on and er thwhsh re"
    for insult in ("idiot", "moron", "stupid", "worthless", "pathetic"):
        base = model.probability(np.array([model.read([f"{clean} {insult} of"], {})[0][0]]))[0]
        assert base >= 0.7
        for spoilt in (insult.upper(), " ".join(insult), "-".join(insult), insult[:2] + "*" + insult[2:], f"({insult}!!)"):
            assert model.probability(np.array([model.read([f"{clean} {spoilt} of"], {})[0][0]]))[0] >= 0.7, spoilt
    assert model.probability(np.array([model.read([clean], {})[0][0]]))[0] < 0.5


@pytest.mark.parametrize("insult", ["idiot", "moron", "stupid", "worthless", "pathetic"])
def test_inserted_letters_are_tolerated(model, insult):
    """In a document of eight clean words: any one letter put in anywhere, two letters put in anywhere."""
    def share(spoilt):
        got = model.read([f"the ththand of on and {x} er thwhsh re" for x in spoilt], {})
        return (model.probability(np.array([e for e, _ in got])) >= 0.7).mean()
    inside = range(1, len(insult))
    assert share([insult[:i] + c + insult[i:] for i in inside for c in "abcdefghijklmnopqrstuvwxyz"]) >= 0.9
    assert share([insult[:i] + c + insult[i:j] + c + insult[j:] for i in inside for j in inside if j >= i for c in "xq"]) >= 0.7
    assert share([insult[:i] + "-" + insult[i:] for i in inside]) == 1


def test_sentences_and_windows():
    assert sentences("One two. Three!\n\nfour? i.d.i.o.t") == ["One two.", "Three!", "four?", "i.d.i.o.t"] and sentences(" \n") == []
    assert "idiot" in windows("An i.d.i.o.t he is") and windows("") == set()
    long = "x" * 20 + "idiot" + "y" * 40
    assert all(any(long[i:i + 8] in w for w in windows(long)) for i in range(len(long) - 8))


def test_hinge_by_plain_gradient():
    rng = np.random.default_rng(0)
    x, y, c = rng.standard_normal((300, 4)), np.sign(rng.standard_normal(300)), rng.random(300)
    w = squared_hinge(x, y, c)
    gap = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
    grad = np.r_[w[:-1], 1e-4 * w[-1]] - 2 * np.hstack([x, np.ones((300, 1))]).T @ (c * y * gap)
    assert np.abs(grad).max() < 1e-6


def test_short_and_inner_witnesses(spark):
    """Insults of two letters, and in the middle of a token, are learnt; no list of witnesses is cut."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghklmnoprstu"), int(rng.integers(3, 9)))) for _ in range(3_000)]
    rows = []
    for i in range(900):
        found = list(rng.choice(words, 15))
        if i % 3 == 0:
            found.append("xq" if i % 2 else f"{rng.choice(words)}vwzjy{rng.choice(words)}")
        rows.append((i, " ".join(rng.permutation(found)), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    m = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").filter(~toxicity.held_out()))
    got = toxicity.score(df.select("doc_id", "text"), m).join(df.select("doc_id", "toxic"), "doc_id").filter(toxicity.held_out()).collect()
    assert sum(r.predicted != r.toxic for r in got) <= 0.08 * len(got)


def test_forms():
    assert forms("(idiot!!)") == ["idiot"] and "idiot" in forms("i-d-i-o-t") and "idiot" in forms("1d10t")
    assert len(forms("y" * 100)) > 3 and forms("###") == ["#"]
    assert "idiot" in tokens("so i d i o t s"[:-2]) and tokens("") == set()


def test_odd_rows(odd, empty, model):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    left = toxicity.reject_toxic(odd, model)
    assert left.columns == odd.columns and left.count() == sum(r.predicted == 0 for r in rows)
    assert toxicity.score(empty, model).count() == 0 and toxicity.reject_toxic(empty, model).count() == 0


def test_no_or_odd_labels(spark, odd):
    labels = spark.createDataFrame([(4, 0), (5, None), (None, 1), (6, 7)], "doc_id long, toxic int")
    flat = toxicity.fit(odd, labels)
    assert {round(r.score, 6) for r in toxicity.score(odd, flat).collect()} == {0.0}
    both = labels.unionByName(spark.createDataFrame([(6, 1)], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in toxicity.score(odd, toxicity.fit(odd, both)).collect()} == {0.5}
    assert toxicity.fit(odd.limit(0), labels).probability(np.zeros(5))[0] < 1e-6


def test_constant_model():
    assert ToxicityModel().probability(np.zeros(5))[0] < 1e-9


def test_held_out_rule(spark):
    import zlib
    df = spark.range(50).select(F.col("id").alias("doc_id"), toxicity.held_out().alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def _labelled(spark, toxic, clean, wordier=1):
    """Documents of invented words, the toxic ones ``wordier`` times as long and with one insult each."""
    rng, insults = np.random.default_rng(5), ["idiot", "moron", "stupid", "worthless", "pathetic"]
    words = ["".join(rng.choice(list("abcdefghklmnoprstuvw"), 6)) for _ in range(2_000)]
    rows = []
    for i in range(toxic + clean):
        bad = i < toxic
        found = list(rng.choice(words, 20 * (wordier if bad else 1)))
        rows.append((i, " ".join([*found, insults[i % 5]] if bad else found), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


@pytest.mark.parametrize(("toxic", "clean", "wordier"), [(400, 400, 1), (600, 200, 1), (150, 1350, 4)])
def test_labels_of_any_balance_are_learnt(spark, toxic, clean, wordier):
    docs, labels = _labelled(spark, toxic, clean, wordier)
    m = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    got = toxicity.score(docs, m).join(labels, "doc_id").filter(toxicity.held_out()).collect()
    assert len({round(r.score, 9) for r in got}) > 1
    assert sum(r.predicted != r.toxic for r in got) <= 0.05 * len(got)


def test_the_fit_holds_its_matrix_once():
    import tracemalloc

    from martwright.llm import toxicity
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(15_000)]
    bad, good = {w: (3, 0) for w in words[:40]}, words[40:]
    sizes = []
    given = toxicity.squared_hinge
    try:
        toxicity.squared_hinge = lambda x, *more, **named: sizes.append(x.nbytes) or given(x, *more, **named)
        tracemalloc.start()
        model = toxicity._fit_words(good, good[:8_000], bad, words[:5], np.random.default_rng(1))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        toxicity.squared_hinge = given
    assert (model.decide(words[:40]) > model.decide(good[:40])).all()
    assert peak < sizes[0] + (48 << 20), (peak, sizes)       # beside it, only pieces


def test_instances_that_share_a_row():
    rng = np.random.default_rng(2)
    x, rows = rng.normal(size=(50, 4)), rng.integers(0, 50, 5000)
    y, weight = np.where(rng.random(5000) < 0.5, 1.0, -1.0), rng.random(5000)
    assert np.allclose(squared_hinge(x, y, weight, rows=rows), squared_hinge(x[rows], y, weight))


def test_kernel_in_pieces(monkeypatch):
    from martwright.llm import toxicity
    words = ["idiot", "idxiot", "stuff", "stupid", "", "a", "moron"] * 90
    whole = kernel(words, words[:7])
    monkeypatch.setattr(toxicity, "PAIRS_AT_ONCE", 5)
    assert np.allclose(kernel(words, words[:7]), whole) and whole.shape == (630, 7)
