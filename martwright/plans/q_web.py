"""Catalogue: web-table extraction.

Link texts come from the ``pages`` table as it is.  The stored pages carry no
``table-01`` table, so the table queries read pages rendered from the order
lines: page ``page_id`` gets the lines of the order of that number as a table
with the market's headers, one row per line, and one link per row between the
first and the last hour label (two lines at least).  Extraction must give back
the lines; the oracle reads them from ``lineitem`` itself.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import webtable as W
from .catalog import query, tables

_TEXT = ("replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), "
         "'&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')")
_LINKS = f"list_transform(regexp_extract_all(html, '{W.A_PATTERN.replace(chr(39), chr(39) * 2)}', 1), lambda x: {_TEXT})"


@query("web_link_texts", f"SELECT page_id, {_LINKS} AS links FROM pages")
def web_link_texts(spark, sf):
    (p,) = tables(spark, sf, "pages")
    return p.select("page_id", W.link_texts("html").alias("links"))


def rendered_pages(pages: DataFrame, lineitem: DataFrame) -> DataFrame:
    """``page_id, url, html``: each page with its order's lines as a table."""
    cells = [F.col("l_quantity").cast("decimal(18,2)"), F.col("l_extendedprice").cast("decimal(18,2)"),
             F.col("l_discount").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(18,2)"),
             F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")]
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    F.array(*[c.cast("string") for c in cells]).alias("cells"))
    # only the lines of the pages are grouped
    own = lineitem.join(pages.select("page_id"), F.col("l_orderkey") == F.col("page_id"), "left_semi")
    orders = own.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    both = pages.join(orders, F.col("page_id") == F.col("l_orderkey"), "left")
    both = both.withColumn("lines", F.coalesce("lines", F.array().cast(orders.schema["lines"].dataType)))
    label = F.transform("lines", lambda x, i: F.when(i == 0, W.FIRST_LABEL).when(i == F.size("lines") - 1, W.LAST_LABEL)
                        .otherwise(F.concat(F.lit("row "), (i + 1).cast("string"))))
    short = (F.col("page_id") % 10 == 3) & (F.size("lines") > 2)
    label = F.when(short, F.filter(label, lambda x, i: i != 1)).otherwise(label)
    links = F.array_join(F.transform(label, lambda x: F.concat(F.lit("<a>"), x, F.lit("</a>"))), "")
    head = "<tr>" + "".join(f"<th> {c} </th>" for c in W.OUTPUT_COLUMNS) + "</tr><tr><th></th></tr>"
    rows = F.array_join(F.transform("lines", lambda x: F.concat(
        F.lit("<tr><td>"), F.array_join(x["cells"], "</td><td>"), F.lit("</td></tr>"))), "\n")
    return both.select(
        "page_id", "url", F.concat("html", F.lit("<a>Home</a>"), links, F.lit(f'<a>Imprint</a><table class="{W.TABLE_CLASS} js">{head}'),
                                   rows, F.lit("</table>")).alias("html"))


def _rendered(spark, sf) -> DataFrame:
    return rendered_pages(*tables(spark, sf, "pages", "lineitem"))


def _safe(c):
    return re.sub(r"[^0-9A-Za-z]+", "_", c).strip("_")


_NAMES = [_safe(c) for c in W.OUTPUT_COLUMNS]
_CELLS = ["CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR)", "CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)",
          "CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR)", "CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR)",
          "CAST(l_partkey AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)"]
# the lines themselves: position in the order, label of the position, cells
_LINES = f"""
WITH n AS (
  SELECT l_orderkey AS page_id, {", ".join(f"{e} AS {c}" for e, c in zip(_CELLS, _NAMES[1:], strict=True))},
    CAST(row_number() OVER w - 1 AS INTEGER) AS row_pos, count(*) OVER (PARTITION BY l_orderkey) AS size
  FROM lineitem WHERE l_orderkey IN (SELECT page_id FROM pages)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
lines AS (
  SELECT *, page_id % 10 = 3 AND size > 2 AS cut,
         CASE WHEN row_pos = 0 THEN '{W.FIRST_LABEL}' WHEN row_pos = size - 1 THEN '{W.LAST_LABEL}'
              ELSE 'row ' || CAST(row_pos + 1 AS VARCHAR) END AS own,
         CASE WHEN row_pos + 1 = size - 1 THEN '{W.LAST_LABEL}' WHEN row_pos + 1 < size
              THEN 'row ' || CAST(row_pos + 2 AS VARCHAR) END AS next
  FROM n)"""


@query("web_table_headers", f"""
SELECT page_id, [{", ".join(f"'{c}'" for c in W.OUTPUT_COLUMNS[1:])}] AS headers FROM pages""")
def web_table_headers(spark, sf):
    return _rendered(spark, sf).select("page_id", W.table_headers(W.table_html("html")).alias("headers"))


@query("web_table_rows", f"""{_LINES}
SELECT page_id, row_pos, [{", ".join(_NAMES[1:])}] AS cells FROM lines""")
def web_table_rows(spark, sf):
    rows = W.table_rows(W.table_html("html"))
    return _rendered(spark, sf).select("page_id", F.posexplode(rows).alias("row_pos", "cells"))


@query("web_link_slice", f"""{_LINES}
SELECT p.page_id, coalesce(list(own ORDER BY row_pos) FILTER (size > 1 AND NOT (cut AND row_pos = 1)), CAST([] AS VARCHAR[])) AS hours
FROM pages p LEFT JOIN lines USING (page_id) GROUP BY p.page_id""")
def web_link_slice(spark, sf):
    return _rendered(spark, sf).select("page_id", W.slice_between(W.link_texts("html")).alias("hours"))


@query("web_table_zip", f"""{_LINES}
SELECT page_id, row_pos, size > 1 AND NOT cut AS labels_match,
       CASE WHEN size > 1 THEN CASE WHEN cut AND row_pos > 0 THEN next ELSE own END END AS {_NAMES[0]},
       {", ".join(_NAMES[1:])} FROM lines""")
def web_table_zip(spark, sf):
    wide = W.to_wide(W.extract_tables(_rendered(spark, sf)))
    return wide.select("page_id", "row_pos", "labels_match",
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(W.OUTPUT_COLUMNS, _NAMES, strict=True)])
