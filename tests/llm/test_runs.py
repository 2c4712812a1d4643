import hashlib
import random
import zlib

import numpy as np
import pytest

from martwright.llm import queries
from martwright.llm.runs import _sweep, find_runs, periodic_runs

COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(w):
    """Every lag, every stretch; the smallest lag of a stretch is its period."""
    n, seen = len(w), {}
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                seen.setdefault((i - q, j), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def collapse(w, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def got_of(w):
    (runs, text), = _sweep([None], [[x.encode() for x in w]])
    return [(r["start"], r["length"], r["period"]) for r in runs], text.decode().split()


@pytest.mark.parametrize("seed", range(40))
def test_all_runs_by_brute_force(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        n = rnd.randrange(0, 90)
        w = [rnd.choice("ab" if seed % 3 else "abcd") for _ in range(n)]
        if seed % 2:  # nested and neighbouring periods
            unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 9))]
            at = rnd.randrange(0, n + 1)
            w[at:at] = unit * rnd.randrange(2, 9) + unit[:rnd.randrange(0, len(unit) + 1)]
        want = brute_runs(w)
        assert got_of(w) == (want, collapse(w, want)), w


def test_documents_do_not_mix():
    a, b = "x y x y x y x".split(), "y x y x y x y x z z z z z".split()
    words = {"x": 0, "y": 1, "z": 2}
    s, n, q = find_runs(np.array([words[t] for t in a + b]), np.array([0] * len(a) + [1] * len(b)))
    assert list(zip(s, n, q, strict=True)) == [(7, 8, 2)]


def test_one_word_a_hundred_thousand_times():
    assert got_of(["w"] * 100_000)[0] == [(0, 100_000, 1)]
    long = [f"w{i % 25_000}" for i in range(100_000)]
    assert got_of(long)[0] == [(0, 100_000, 25_000)] and got_of(long[:99_999])[0] == []


def want_row(i, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (i, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(collapse(w, runs))))


def test_query_by_brute_force(spark, small, documents):
    texts = [(r.doc_id, r.text) for r in documents.collect() if len(r.text or "") < 8_000]
    want = dict((t[0], want_row(*t)) for t in texts)
    got = {r.doc_id: tuple(r) for r in queries.op13(spark, small).select(COLS).collect()}
    assert len(got) == documents.count()
    assert {i: got[i] for i in want} == want
    assert sum(w[1] > 0 for w in want.values()) > 5


def test_odd_rows(odd, empty):
    rows = periodic_runs(odd).collect()
    assert len(rows) == odd.count() and periodic_runs(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].runs == [] and by[1].collapsed == "" and by[1].n_words == 0
    assert [tuple(r) for r in by[7].runs] == [(0, 30_000, 1)] and by[7].collapsed == "word"
    assert by[None].n_words == 4
