import hashlib
import re

from martwright.llm import queries
from martwright.llm.exact_dedup import drop_copies, exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_matches_oracle(spark, small, con):
    got = queries.op9(spark, small)
    want = con.execute(queries.ORACLE["op9_exact_dedup"]).fetchall()
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(want)


def test_odd_rows(odd):
    rows = exact_dedup(odd, digest_all=True).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert (by[1].keep_id, by[2].keep_id, by[2].group_size) == (2, 2, 2)
    assert (by[4].keep_id, by[4].group_size, by[4].kept) == (5, 3, False)
    assert sorted(r.kept for r in rows if r.doc_id == 5) == [False, True]
    assert by[None].kept and by[None].keep_id is None
    assert by[6].text_sha256 == hashlib.sha256(lower(dict((r.doc_id, r.text) for r in odd.collect())[6]).encode()).hexdigest()


def test_tiny_bitmap_changes_nothing(documents):
    key = lambda df: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect())
    assert key(exact_dedup(documents, bits=64)) == key(exact_dedup(documents))


def test_unique_rows_are_not_read_in_full(documents):
    rows = exact_dedup(documents).collect()
    assert all(r.text_sha256 is None or r.group_size >= 1 for r in rows)
    assert any(r.text_sha256 is None for r in rows)
    assert all(r.group_size == 1 for r in rows if r.text_sha256 is None)


def test_drop_copies_keeps_columns_and_one_of_each(odd, empty):
    left = drop_copies(odd)
    assert left.columns == odd.columns
    rows = left.collect()
    assert sorted((lower(r.text) for r in rows)) == sorted({lower(r.text) for r in odd.collect()})
    assert sum(r.doc_id == 5 for r in rows) == 1 and all(r._id == "clash" for r in rows)
    assert drop_copies(empty).count() == 0 and exact_dedup(empty).count() == 0


def test_large_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    rows = exact_dedup(df).collect()
    hot = [r for r in rows if r.doc_id % 3 == 0]
    assert {(r.keep_id, r.group_size) for r in hot} == {(2997, 1000)} and sum(r.kept for r in hot) == 1


def test_bitmaps_are_not_written_out_in_plans(documents):
    digits = re.compile(r"[0-9A-Fa-f]{1000}")
    for df in (exact_dedup(documents), drop_copies(documents)):
        df.collect()
        assert not digits.search(df._jdf.queryExecution().toString())
    store = documents.sparkSession._jsparkSession.sharedState().statusStore()
    last = store.executionsList(max(0, store.executionsCount() - 15), 15)
    assert not any(digits.search(last.apply(i).physicalPlanDescription()) for i in range(last.size()))
