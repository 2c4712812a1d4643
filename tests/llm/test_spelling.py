import random
import re
import zlib
from collections import Counter

import pytest

from martwright.llm import queries, spelling
from martwright.llm.common import pin
from martwright.llm.spelling import decompose, frequent_grams, near_pairs, postings_of, spelling_variants

COLS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows, typo_every=None):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if typo_every:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % typo_every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute(words, times=10):
    near = {w: [o for o in words if abs(len(o) - len(w)) <= 1 and one_apart(w, o)] for w in words}
    form = {}
    for w, os in near.items():
        best = min(os, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.select(COLS).collect())


def test_query_by_brute_force(spark, small, documents):
    words = counted([(r.doc_id, r.text) for r in documents.collect()], 31)
    want = brute(words)
    assert told(queries.op11(spark, small)) == want
    assert len(want) > 500 and sum(w[4] for w in want) > 100


def test_long_runs():
    texts = ["", "abcdefg hij", "x" * 9 + "1" + "É" * 8, "end abcdefgh", "ijklmnop \U0001F600ABCDEFG\x00qrstuvw", "Œuvres-uvresÿÀ"]
    want = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w).encode("latin-1")
             for w in re.findall("[A-Za-zÀ-ÿ]{7,}", t)] for t in texts]
    assert spelling.long_runs(texts, 7) == want and spelling.long_runs([], 7) == []


@pytest.mark.parametrize("rare", [2, 20, 1_000])
def test_near_pairs_by_brute_force(spark, rare):
    """Few letters, so grams are frequent and edits ambiguous; every dictionary gives the same pairs."""
    rnd = random.Random(rare)
    words = sorted({"".join(rnd.choice("abÿ") for _ in range(rnd.randrange(7, 11))) for _ in range(500)}
                   | {"a" * n for n in range(7, 14)})
    table = pin(spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long"))
    got = sorted((r.word, r.other) for r in near_pairs(table, rare).collect())
    assert got == sorted((a, b) for a in words for b in words if one_apart(a, b))


def test_grams_follow_the_dictionary(spark):
    table = pin(spark.createDataFrame([("banana" * 2, 2), ("bandage", 2), ("zyxwvuts", 2)], "word string, n long"))
    frequent = frequent_grams(table, rare=8)
    assert "an" in frequent and "zy" not in frequent
    grams, ends = decompose("bandage", {"an", "ba", "ban"})
    assert grams == ["band", "and", "nd", "da", "ag", "ge"] and ends == [4, 4, 4, 5, 6, 7]
    assert decompose("nana", {"na"}) == (["nan", "an", "na"], [3, 3, 5])  # the last could grow


def test_every_place_leaves_a_gram():
    for frequent in (set(), {"aa", "aaa"}):
        for n in (7, 8, 12):
            assert all(re.search("[a-z]", said) for _, _, said in postings_of("a" * n, frequent))


def test_roots_follow_long_chains(spark):
    chain = [("aaaaaaa" + "b" * i, 3 * 10 ** (9 - i)) for i in range(9)]
    text = pin(spark.createDataFrame(chain, "word string, n long"))
    forms = pin(spark.createDataFrame([(chain[i][0], chain[i - 1][0]) for i in range(1, 9)], "word string, form string"))
    assert {r.root for r in spelling.roots(forms).collect()} == {chain[0][0]} and near_pairs(text).count() == 16


def test_odd_rows(odd, empty, spark):
    assert spelling_variants(empty).columns == COLS and spelling_variants(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert told(spelling_variants(odd, typo_every=31)) == brute(counted(rows, 31))
    assert told(spelling_variants(odd)) == brute(counted(rows))
    same = spark.createDataFrame([(None, "Straße×mann strasse STRASSE strasze " * 40), (1, None), (1, "strassse strassse")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in same.collect()]
    assert told(spelling_variants(same)) == brute(counted(rows)) and len(counted(rows)) == 4
    with pytest.raises(ValueError):
        spelling_variants(odd, min_length=6)
