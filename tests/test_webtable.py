"""Web-table extraction on the inline fixture (FIXTURES.md section 4)."""

from martwright.sources import webtable as W

FIXTURE = """<a>Home</a><a>00 - 01</a><a>01 - 02</a><a>23:45 - 24:00</a><a>Imprint</a>
<table class="table-01 js"><tr><th>Hours</th><th> Low(€/MWh) </th><th>High(€/MWh)</th></tr><tr><th></th></tr>
<tr><td>1.5</td><td>2.5</td></tr><tr><td>3.0</td><td>4.0</td></tr><tr><td>5.0</td><td>6.0</td></tr></table>"""


def _pages(spark):
    return spark.createDataFrame([(1, "u1", FIXTURE), (2, "u2", "<a>x</a><p>no table</p>")],
                                 "page_id bigint, url string, html string")


def test_rows_headers_and_labels(spark):
    rows = W.extract_tables(_pages(spark)).orderBy("row_pos").collect()
    assert len(rows) == 3 and {r.page_id for r in rows} == {1}
    assert rows[0].headers == ["Low(€/MWh)", "High(€/MWh)"]
    assert [r.cells for r in rows] == [["1.5", "2.5"], ["3.0", "4.0"], ["5.0", "6.0"]]
    assert [r.hours for r in rows] == ["00 - 01", "01 - 02", "23:45 - 24:00"]
    assert all(r.labels_match for r in rows)


def test_wide_output(spark):
    wide = W.to_wide(W.extract_tables(_pages(spark))).orderBy("row_pos").collect()
    assert wide[0]["Hours"] == "00 - 01"
    assert wide[0]["Low(€/MWh)"] == "1.5" and wide[2]["High(€/MWh)"] == "6.0"
    assert wide[0]["Volume(MWh)"] is None


def test_links_and_slice(spark):
    from pyspark.sql import functions as F
    r = _pages(spark).select(W.link_texts("html").alias("l")).orderBy(F.size("l").desc()).first()
    assert r.l == ["Home", "00 - 01", "01 - 02", "23:45 - 24:00", "Imprint"]
    s = _pages(spark).select(W.slice_between(W.link_texts("html")).alias("s")).collect()
    assert sorted(len(x.s) for x in s) == [0, 3]


def test_case_and_quote_variants(spark):
    html = ("<A HREF='x'>00 - 01</A><a>23:45 - 24:00</a>"
            "<TABLE class='other table-01'><TR><TH>Hours</TH><TH>Low(€/MWh)</TH></TR><tr><th></th></tr>"
            "<TR><TD class=\"v\">7</TD></TR><tr><td>8</td></tr></TABLE>")
    pages = spark.createDataFrame([(9, "u", html)], "page_id bigint, url string, html string")
    rows = W.extract_tables(pages).orderBy("row_pos").collect()
    assert [r.cells for r in rows] == [["7"], ["8"]]
    assert [r.hours for r in rows] == ["00 - 01", "23:45 - 24:00"]
    assert rows[0].headers == ["Low(€/MWh)"]
