import math
import random
import re
from collections import Counter

import pytest

from martwright.llm.licenses import BAND, TEMPLATES, WORDS, TemplateIndex, gram_and_window, scan_licenses

MIT = TEMPLATES["mit"]


def full_alignment(tpl, text):
    """Best local alignment over the whole text, without band or index: (matched, score)."""
    a, b = [w.lower() for w in WORDS.findall(tpl)], [w.lower() for w in WORDS.findall(text)]
    best, before = (0, 0), [(0, 0)] * (len(b) + 1)
    for x in a:
        row = [(0, 0)]
        for i, y in enumerate(b, 1):
            s, k = before[i - 1]
            row.append(max((0, 0), (s + 2, k + 1) if x == y else (s - 1, k), (before[i][0] - 1, before[i][1]),
                           (row[-1][0] - 1, row[-1][1])))
        before = row
        best = max([best, *row])
    return best[1], best[0]


def filler(rng, n):
    return " ".join("".join(rng.choice("bcdfghjkl") for _ in range(5)) for _ in range(n))


def test_spans_and_coverage():
    index = TemplateIndex(TEMPLATES)
    rng = random.Random(1)
    text = f"{filler(rng, 40)}\n{MIT}\n{filler(rng, 40)}\n{TEMPLATES['apache-2.0-notice']}"
    got = index.scan(text, 0.8)
    assert [g[0] for g in got] == ["mit", "apache-2.0-notice"]
    assert text[got[0][4]:got[0][5]] == MIT.rstrip(".") and got[0][1] == 1.0
    assert text[got[1][4]:got[1][5]] == TEMPLATES["apache-2.0-notice"].rstrip(".")


def test_changed_copies_against_full_alignment():
    rng = random.Random(2)
    index = TemplateIndex({"mit": MIT}, 0.5)
    words = MIT.split()
    for _ in range(25):
        w = list(words)
        for _ in range(rng.randrange(0, 18)):
            i = rng.randrange(len(w))
            w[i:i + rng.randrange(2)] = [] if rng.random() < 0.4 else [filler(rng, 1)]
        text = f"{filler(rng, rng.randrange(30))} {' '.join(w)} {filler(rng, 20)}"
        k, _ = full_alignment(MIT, text)
        got = index.scan(text, 0.0)
        assert abs(len(w) - len(words)) <= BAND and got and max(g[2] for g in got) >= k - 1


def changes(words, rng, pairs):
    """Every one-word change (another word, a missing one, one put in) and some two-word changes."""
    def one(w, i, how):
        return w[:i] + ([] if how == "missing" else ["zzqq"] if how == "changed" else ["zzqq", w[i]]) + w[i + 1:]
    hows = ("changed", "missing", "inserted")
    singles = [one(words, i, h) for i in range(len(words)) for h in hows]
    every = [(i, j, a, b) for i in range(len(words)) for j in range(i + 1, len(words)) for a in hows for b in hows]
    some = every if len(every) <= pairs else rng.sample(every, pairs)
    return singles + [one(one(words, j, b), i, a) for i, j, a, b in some]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_no_match_is_lost(name):
    """Each template alone: every one-word and (all, or many) two-word changes that full
    alignment puts at 0.8 or more are reported, where they stand."""
    words, rng = TEMPLATES[name].split(), random.Random(name)
    index = TemplateIndex({name: TEMPLATES[name]}, 0.8)
    m = len(index.ids[0])
    tried = changes(words, rng, 700 if m < 40 else 60)
    if m >= 40:
        tried = rng.sample(tried, 90)
    found = 0
    for w in tried:
        text = f"bcdfg hjklb {' '.join(w)} dfghj klbcd fghjk"
        k, _ = full_alignment(TEMPLATES[name], text)
        got = index.scan(text, 0.8)
        if k / m >= 0.8:
            found += 1
            assert got and got[0][2] >= min(k, math.ceil(0.8 * m)), " ".join(w)
    assert found > 0


def test_gram_and_window():
    assert gram_and_window(5, 0.8) == (2, 1) and gram_and_window(8, 0.8) == (3, 1) and gram_and_window(3, 0.8) == (1, 1)
    assert gram_and_window(100, 0.8) == (3, 2) and gram_and_window(100, 0.95) == (3, 3) and gram_and_window(1, 0.8) == (1, 1)


def test_whole_texts_and_families():
    index = TemplateIndex(TEMPLATES)
    for name, others in (("mit-whole", {"mit"}), ("isc-whole", {"isc"}), ("bsd-2-clause", {"bsd"}), ("zlib", set()), ("lgpl", set()),
                         ("agpl", set()), ("gpl", set()), ("epl-2.0", set())):
        got = {g[0] for g in index.scan(f"bcdfg hjklb {TEMPLATES[name]} dfghj", 0.8)}
        assert name in got and got - {name} <= others, (name, got)


def test_sibling_is_not_reported():
    index = TemplateIndex(TEMPLATES)
    assert [g[0] for g in index.scan("x Licensed under CC BY-NC 4.0. y", 0.8)] == ["cc-by-nc-4.0-notice"]
    assert [g[0] for g in index.scan("x Licensed under CC BY 4.0. y", 0.8)] == ["cc-by-4.0-notice"]
    assert {g[0] for g in index.scan(TEMPLATES["apache-2.0"], 0.8)} >= {"apache-2.0", "apache-2.0-notice"}


def test_repeats_and_clean_text():
    index = TemplateIndex(TEMPLATES)
    rng = random.Random(3)
    text = "\n".join([TEMPLATES["mit-notice"], filler(rng, 50)] * 40)
    assert len(index.scan(text, 0.8)) == 40
    assert index.scan(filler(rng, 5000), 0.8) == [] and index.scan("the license of the software is", 0.8) == []
    assert TemplateIndex({"empty": " . "}).names == []


def test_every_notice_in_documents(spark, documents):
    want = sorted((r.doc_id, n) for r in documents.collect() for n in TEMPLATES
                  if n.endswith("-notice") and TEMPLATES[n] in (r.text or ""))
    got = sorted({(r.doc_id, r.license) for r in scan_licenses(documents).collect()})
    assert want and got == want


def test_every_licence_line_in_documents(spark):
    """Whatever the templates: each short line about rights that stands in several texts is found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    asks = re.compile(r"licen[cs]|rights|reserved|copyright", re.IGNORECASE)
    lines = [(r.doc_id, x.strip()) for r in docs.collect() for x in set((r.text or "").splitlines())
             if asks.search(x) and len(x.split()) <= 15]
    often = Counter(x for _, x in lines)
    want = {(d, x) for d, x in lines if often[x] > 1}
    got = {(r.doc_id, r.span_text + ".") for r in scan_licenses(docs).collect()}
    assert len({x for _, x in want}) >= 5 and want <= got


def test_neighbouring_notices_are_all_reported():
    index = TemplateIndex(TEMPLATES)
    for name in ("all-rights-reserved-notice", "mit-notice"):
        assert [g[0] for g in index.scan("\n".join([TEMPLATES[name]] * 3), 0.8)] == [name] * 3
    assert {g[0] for g in index.scan(TEMPLATES["copyright"], 0.8)} == {"copyright", "all-rights-reserved-notice"}


def test_odd_rows(spark, odd, empty):
    assert scan_licenses(odd).count() == 0 and scan_licenses(empty).count() == 0
    df = spark.createDataFrame([(1, "word " * 20_000 + "Released under the MIT License."), (1, None), (None, "Released under the MIT License.")],
                               "doc_id long, text string").selectExpr("*", "1 as _id", "2 as license")
    assert sorted((str(r.doc_id), r.span_text) for r in scan_licenses(df).collect()) == [
        ("1", "Released under the MIT License"), ("None", "Released under the MIT License")]
    assert scan_licenses(df, {}).count() == 0
