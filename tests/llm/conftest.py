import duckdb
import pytest

from martwright.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return queries.table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


#: null, empty, blank, tied, repeated and long texts; clashing names of further columns
ODD = [
    (1, None, "a", 1), (2, "", "a", 2), (3, "   \n\t ", None, 3), (4, "Same text here", "b", 4),
    (5, "SAME text HERE", "b", 5), (5, "SAME text HERE", "b", 5), (6, "éÉ ünïcödé   x y 'll don't '' 'S", "c", 6),
    (None, "no id at all", "c", 7), (7, "word " * 30_000, "c", 8), (8, "<|endoftext|>a <|endoftext|> b<|endoftext|>", "d", 9),
    (9, "x" * 100_000, "d", 10), (10, "\U0001F600 emoji \x00 nul \t\t\r\n  end  ", "d", 11),
]
ODD_SCHEMA = "doc_id long, text string, source string, kept long"


@pytest.fixture(scope="session")
def odd(spark):
    """``kept``, ``_id``, ``score`` and others are names the operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    for c in ("_id", "_text", "_r", "score", "ids", "component_id", "_order", "lang", "_sha", "keep_id"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
