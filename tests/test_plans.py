"""Plan guards: no cartesian products, no nested-loop joins, no Python
evaluation and no sort-based aggregation in any relational query; the donor
mart reads orders once."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry
from martwright.plans import catalog

catalog.load_all()

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "SortAggregate", "ObjectHashAggregate"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_no_forbidden_operators(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    # the web queries gather each order's lines into the page they read
    rendered = name.startswith("web_table") or name == "web_link_slice"
    bad = [op for op in FORBIDDEN if op in plan and not (rendered and op == "ObjectHashAggregate")]
    assert not bad, f"{name}: {bad}"


def test_donor_mart_reads_orders_once(spark, sf_dir):
    plan = _plan(entry.queries()["mart_donor"](spark, sf_dir))
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert sum("o_orderdate" in s for s in scans) == 1
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2


@pytest.mark.parametrize("name", ["mart_donor", "mart_churn", "trailing_window_sums", "asof_filter"])
def test_date_predicates_reach_the_scan(spark, sf_dir, name):
    plan = _plan(entry.queries()[name](spark, sf_dir))
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert any("o_orderdate" in p for p in pushed), pushed


def test_scans_read_only_used_columns(spark, sf_dir):
    plan = _plan(entry.queries()["mart_donor"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    orders = [s for s in schemas if "o_orderdate" in s]
    assert orders and all("o_orderpriority" not in s and "o_orderstatus" not in s for s in orders)
