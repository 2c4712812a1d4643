"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)``, reads the driver tables and
returns a DataFrame.  Relational ones are lazy; those that fit something
(models, scalers, caps, segments) or pin rows for a prefix sum run jobs while
they are built; the oracle is an independent SQL statement over
the same tables (views named like the tables).  Queries without an SQL
equivalent (model training) register no oracle; ``tests/test_models.py``
checks properties of the models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [read_table(spark, sf_dir, n) for n in names]


def load_all() -> None:
    from . import q_basic, q_agg, q_marts, q_features, q_eval, q_model, q_neighbours, q_stored, q_web  # noqa: F401
