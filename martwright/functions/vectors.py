"""Vector helpers (native; no Python UDF)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column

from .recode import _col


def vector_element(c, i: int = 1) -> Column:
    """Element ``i`` of an ML vector column as double (e.g. P(class 1))."""
    return vector_to_array(_col(c))[i]
