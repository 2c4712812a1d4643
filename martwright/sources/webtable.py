"""Tables from stored web pages, as one Spark job over a pages table.

Input is a table ``(page_id, url, html)``; every step is a native string /
array expression (``regexp_extract_all``, ``transform``, ``slice``,
``posexplode``), so pages are processed where they are stored, in parallel,
with no Python parser per row.  Each page is handled whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Table class, the first and last hour labels of the link
# list, and the output columns of the market-data table (in order).
TABLE_CLASS = "table-01"
FIRST_LABEL = "00 - 01"
LAST_LABEL = "23:45 - 24:00"
OUTPUT_COLUMNS = ["Hours", "Low(€/MWh)", "High(€/MWh)", "Last(€/MWh)", "Weight Avg.(€/MWh)",
                  "Buy Volume(MWh)", "Sell Volume(MWh)", "Volume(MWh)"]

# tag names are case-insensitive in HTML; attributes may follow the name
A_PATTERN = r"(?is)<a(?:\s[^>]*)?>(.*?)</a>"
TH_PATTERN = r"(?is)<th(?:\s[^>]*)?>(.*?)</th>"
TD_PATTERN = r"(?is)<td(?:\s[^>]*)?>(.*?)</td>"
TR_PATTERN = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"


def table_pattern(css_class: str) -> str:
    """First ``<table>`` whose class list contains ``css_class`` (either
    quote style); its inner HTML is group 1.  Nested tables are not
    expected in these pages."""
    return (r"(?is)<table\s[^>]*class\s*=\s*[\"'](?:[^\"']*\s)?" + css_class +
            r"(?:\s[^\"']*)?[\"'][^>]*>(.*?)</table>")


def text_of(x: Column) -> Column:
    """Element text: inner tags removed, basic entities decoded."""
    t = F.regexp_replace(x, "<[^>]+>", "")
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return t


def _extract_all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), 1)


def link_texts(html: str | Column = "html") -> Column:
    """Texts of all ``<a>`` elements of the page, in document order."""
    h = F.col(html) if isinstance(html, str) else html
    return F.transform(_extract_all(h, A_PATTERN), text_of)


def slice_between(arr: Column, first: str = FIRST_LABEL, last: str = LAST_LABEL) -> Column:
    """Elements from the first ``first`` to the first ``last`` (inclusive);
    empty when a marker is missing or out of order."""
    i1 = F.array_position(arr, first)
    i2 = F.array_position(arr, last)
    ok = (i1 > 0) & (i2 >= i1)
    return F.when(ok, F.slice(arr, i1.cast("int"), (i2 - i1 + 1).cast("int"))) \
        .otherwise(F.array().cast("array<string>"))


def table_html(html: str | Column = "html", css_class: str = TABLE_CLASS) -> Column:
    """Inner HTML of the first table with the class; '' when absent."""
    h = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract(h, table_pattern(css_class), 1)


def table_headers(table: Column, drop_first: int = 1) -> Column:
    """Trimmed ``th`` texts, empty ones removed, first ``drop_first`` dropped."""
    th = F.transform(_extract_all(table, TH_PATTERN), lambda x: F.trim(text_of(x)))
    th = F.filter(th, lambda x: x != "")
    return F.slice(th, F.lit(drop_first + 1), F.size(th)) if drop_first else th


def table_rows(table: Column, skip_rows: int = 2) -> Column:
    """Array of rows (arrays of ``td`` texts) after the header rows."""
    rows = _extract_all(table, TR_PATTERN)
    rows = F.slice(rows, F.lit(skip_rows + 1), F.size(rows)) if skip_rows else rows
    return F.transform(rows, lambda r: F.transform(_extract_all(r, TD_PATTERN), text_of))


def extract_tables(pages: DataFrame, css_class: str = TABLE_CLASS, skip_rows: int = 2,
                   first: str = FIRST_LABEL, last: str = LAST_LABEL) -> DataFrame:
    """One row per table body row of every page:
    ``page_id, row_pos, hours, headers, cells, labels_match``.

    ``hours`` is the row's label from the link texts between the markers,
    zipped by position; ``labels_match`` is false when the number of labels
    differs from the number of rows (the reference would raise).  Pages
    without the table give no rows.
    """
    t = pages.select("page_id", table_html("html", css_class).alias("_t"),
                     slice_between(link_texts("html"), first, last).alias("_labels"))
    t = t.where(F.col("_t") != "")
    t = t.select("page_id", "_labels", table_headers(F.col("_t")).alias("headers"),
                 table_rows(F.col("_t"), skip_rows).alias("_rows"))
    t = t.select("page_id", "headers", "_labels", "_rows",
                 F.posexplode("_rows").alias("row_pos", "cells"))
    return t.select("page_id", "row_pos", F.get("_labels", F.col("row_pos")).alias("hours"),
                    "headers", "cells",
                    (F.size("_labels") == F.size("_rows")).alias("labels_match"))


def to_wide(rows: DataFrame, columns: Sequence[str] = OUTPUT_COLUMNS,
            label_column: str = "Hours") -> DataFrame:
    """Named string columns: the label column from ``hours``, every other
    column from the cell whose header matches (null when absent)."""
    out = []
    for c in columns:
        if c == label_column:
            out.append(F.col("hours").alias(c))
        else:
            i = F.array_position("headers", c)
            out.append(F.when(i > 0, F.get("cells", i.cast("int") - 1)).alias(c))
    return rows.select("page_id", "row_pos", "labels_match", *out)
