"""Every query with an SQL oracle matches DuckDB on sf0.001 (exact values)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, list):
        return tuple(v)
    return v


def _rows(cols, data):
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


# columns that stay null here: a category no transaction has, references between pages that don't repeat at this scale
ABSENT = {"pivot_mean_of_groups": {f"op_{a}_Remit_other_bank" for a in ("count", "sum", "mean")}, "op6_warc": {"refers_to"}}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_oracle(spark, sf_dir, con, name):
    df = entry.queries()[name](spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert _rows(df.columns, srows) == _rows(ocols, orows)
    # nothing compared is nothing checked: rows there are, no column is all null, arrays hold something
    assert srows
    cells = {c: [r[i] for r in srows] for i, c in enumerate(df.columns)}
    empty = [c for c, v in cells.items() if c not in ABSENT.get(name, ()) and all(x is None or x == [] for x in v)]
    assert not empty, empty
    assert "label" not in cells or len(set(cells["label"])) > 1
    same = {("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"),
            ("date", "DATE"), ("timestamp_ntz", "TIMESTAMP"), ("boolean", "BOOLEAN"),
            ("array<string>", "VARCHAR[]"), ("array<double>", "DOUBLE[]")}
    otypes = {d[0]: str(d[1]) for d in cur.description}
    bad = {f.name: (f.dataType.simpleString(), otypes[f.name]) for f in df.schema.fields
           if (f.dataType.simpleString(), otypes[f.name]) not in same}
    assert not bad, bad


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "donor_id" in df.columns and "label" in df.columns


def test_every_query_has_callable():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert len(q) >= 80


ORDER_SENSITIVE = ["mart_bank", "pivot_mean_of_groups", "profile_describe", "corr_matrix",
                   "chi2_statistic", "auc_score", "gains_by_decile", "mart_churn"]


@pytest.mark.parametrize("name", ORDER_SENSITIVE)
def test_oracle_under_other_partitioning(spark, sf_dir, con, name):
    """Values must not depend on how many shuffle partitions meet."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        df = entry.queries()[name](spark, sf_dir)
        srows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    cur = con.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert _rows(df.columns, srows) == _rows(ocols, cur.fetchall())
