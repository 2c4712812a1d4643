import random

import pytest
import xxhash

from martwright.llm import queries
from martwright.llm.components import component_roots
from martwright.llm.simhash import ball_edges, drop_near_copies, fingerprint, simhash_dedup


def plain_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((sum(v >> b & 1 for v in h) * 2 > len(h)) << b for b in range(64))


def brute(rows, radius=2):
    """{(id, fingerprint): smallest id reachable} over all pairs."""
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    first = {}
    for i, t in rows:
        r = find(plain_fingerprint(t))
        if i is not None:
            first[r] = min(first.get(r, i), i)
    return sorted((str(i), f"{plain_fingerprint(t):016x}", str(first.get(find(plain_fingerprint(t))))) for i, t in rows)


def said(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_query_against_all_pairs(spark, small, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert said(queries.op1(spark, small)) == brute(rows)


def test_near_copies(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"]) + str(rng.randrange(50)) for _ in range(400)) for _ in range(6)]
    rows = [(100 + i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = rng.choice(base).split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = said(simhash_dedup(df))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < 60                        # some were linked
    left = drop_near_copies(df)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted({c for _, _, c in got})


def test_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert said(simhash_dedup(odd)) == brute(rows)
    left = drop_near_copies(odd)
    assert left.columns == odd.columns
    kept = sorted(str(r.doc_id) for r in left.collect())
    assert kept == sorted({c for _, _, c in brute(rows)})
    assert drop_near_copies(empty).count() == 0 and simhash_dedup(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rng = random.Random(radius)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(4):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = ball_edges(spark.createDataFrame([(f,) for f in signed], "_fp long"), radius)
    got = [(e.u % (1 << 64), e.v % (1 << 64)) for e in edges.collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in got)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a, b in got:
        root[find(a)] = find(b)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius:
                assert find(a) == find(b)


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(300)] + [(200, 900), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in component_roots(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 401)}, 900: 100}
    assert component_roots(df.limit(0)).count() == 0


def test_long_text_in_chunks():
    t = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprint(t) == plain_fingerprint(t)
