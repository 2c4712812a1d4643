import base64
import hashlib
import io

import pytest

from martwright.llm import queries, warc
from martwright.llm.common import shared_folder


def test_matches_oracle(spark, small, con):
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = queries.op6(spark, small).select(cols).collect()
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE['op6_warc']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


ODD = [(1, "http://a/", None), (2, None, ""), (3, "http://a b/ü\n", "same"), (4, "dns:x", "same"), (4, "http://c/", "same"),
       (None, "http://d/", "same"), (5, "", "x" * 300_000), (6, "http://e/", "line\r\n\r\nline\nWARC/1.1\r\n"), (7, "http://f/", "é\x00")]


def pages(spark):
    return spark.createDataFrame(ODD, "page_id long, url string, html string").selectExpr("*", "'clash' as _file", "1 as payload")


def test_odd_pages(spark):
    got = warc.pages_through_warc(spark, pages(spark)).collect()
    assert len(got) == len(ODD)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (str(i), len((t or "").encode()), sha(t)) for i, _, t in ODD)
    assert sorted((str(r.page_id), r.refers_to) for r in got if r.record_type == "revisit") == [("2", 1), ("4", 3), ("4", 3), ("None", 3)]


def test_min_bytes(spark):
    got = warc.pages_through_warc(spark, pages(spark), min_bytes=1).collect()
    assert {r.page_id: r.record_type for r in got}[2] == "response"


def test_payloads_survive_both_versions(spark):
    old, new = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    arcs = warc.write_arc(pages(spark).repartition(2, "page_id"), old)
    warcs = warc.convert_arc(arcs, old, new)
    got = warc.read_warc(warcs, new, payload=True).collect()
    kept = {r.payload_digest: bytes(r.payload).decode() for r in got if r.record_type != "revisit"}
    assert set(kept.values()) == {t or "" for _, _, t in ODD}
    assert len({r.record_id for r in got}) == len(ODD)


def test_empty(spark):
    assert warc.pages_through_warc(spark, pages(spark).limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    body = warc.http_response(9, b"hello\n\nworld")
    data = warc.arc_opening(version, "20240101000000")("f.arc") + warc.arc_record(version, "http://x/", "20240101000000", body)
    (head, got), = warc.parse_arc(io.BytesIO(data), "f")
    assert got == body and head["URL"] == "http://x/" and list(head) == warc.FIELDS[version]


@pytest.mark.parametrize("spoil", [lambda d: d[:-9], lambda d: d.replace(b"text/html ", b""), lambda d: d[5:],
                                   lambda d: d.replace(b" 0 martwright", b" 0 x").replace(b"Content-type", b"Type")])
def test_damage_is_named(spoil):
    data = warc.arc_opening(1, "20240101000000")("f.arc") + warc.arc_record(1, "http://x/", "20240101000000", b"0123456789")
    with pytest.raises(ValueError, match="f"):
        list(warc.parse_arc(io.BytesIO(spoil(data)), "f"))


def test_dates():
    assert warc.iso_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert warc.iso_date("199701020304") == "1997-01-02T03:04:00Z"
