import hashlib
from collections import defaultdict

from martwright.llm import line_dedup, queries
from martwright.llm.line_dedup import dedup_lines, repeated_lines

BLANK = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_chars=20, min_documents=3):
    """(id, text) -> list of (id, kept text, lines, dropped)."""
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(k := lower(line.strip(BLANK))) >= min_chars:
                held[k].add(i)
    rank = lambda i: (i is not None, i or 0)
    keep = {k: max(v, key=rank) for k, v in held.items() if len(v) >= min_documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if keep.get(lower(x.strip(BLANK)), i) == i]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return out


def told(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "_n_lines", "_n_dropped").collect()), key=repr)


def test_matches_oracle(spark, small, con):
    cols = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op12_line_dedup']})").fetchall()
    got = queries.op12(spark, small).select(cols).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert sum(r.n_dropped for r in got) > 50


def test_brute_force_and_full_filters(documents):
    """Filters so small that every line is suspected change nothing."""
    want = sorted(brute([(r.doc_id, r.text) for r in documents.collect()]), key=repr)
    assert told(dedup_lines(documents)) == want
    assert told(dedup_lines(documents, max_bits=1 << 16)) == want


def test_merged_blocks_find_every_repeat(spark, monkeypatch):
    """Repeats within a task, between tasks and between flushes are all marked."""
    monkeypatch.setattr(line_dedup, "FLUSH", 50)
    rows = [(i, "\n".join([f"only in document number {i}", f"a line shared by seven, {i % 300}"])) for i in range(2100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert told(dedup_lines(df)) == sorted(brute(rows), key=repr)
    marked = line_dedup.twice_filter(df.selectExpr("text as _text"), 20, 1 << 30)
    keys = [line_dedup.line_key(f"only in document number {i}", 20) for i in range(2100)]
    assert len(line_dedup.suspected(keys, marked)) < 200  # once-seen lines stay unsuspected
    assert repeated_lines(df).count() == 300 * 6


def test_edges(spark):
    line, short, wide = "Twenty characters ok", "nineteen chars only", "é" * 20
    rows = [(1, f"{line}\n{short}\n{wide}"), (2, f"  {line.upper()}\t\r\n{short}\n{line}"), (3, f"x\n{line}\n{line}\n"),
            (4, f"{wide}\n{short}"), (5, wide.upper()), (None, f"{wide}\n{line}"), (None, line), (3, f"{line}"), (6, None), (7, ""), (8, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(dedup_lines(df)) == sorted(brute(rows), key=repr)
    assert told(dedup_lines(df, min_documents=2)) == sorted(brute(rows, min_documents=2), key=repr)


def test_hot_line(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('id ', id, if(id % 3 = 0, '\\na line that a third of all rows hold', '')) as text")
    rows = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert sum(r._n_dropped for r in rows.values()) == 999 and rows[2997]._n_dropped == 0 and rows[3].text == "id 3"


def test_odd_rows(odd, empty):
    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "_n_lines", "_n_dropped"] and dedup_lines(empty).count() == 0
    rows = out.collect()
    assert len(rows) == odd.count() and all(r._id == "clash" for r in rows)
    want = sorted(brute([(r.doc_id, r.text) for r in odd.collect()]), key=repr)
    assert told(out) == want


def test_digest_of_an_emptied_text():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
