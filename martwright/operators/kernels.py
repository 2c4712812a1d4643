"""Random Fourier features: a radial kernel in front of a linear classifier.

``exp(-gamma |x - y|^2)`` is the mean of ``2 cos(w x + b) cos(w y + b)`` over
directions w from a normal distribution and phases b.  With some hundred of
them a linear support vector classifier on the cosines separates what the kernel
machine separates, at the cost of a linear fit: one pass maps the rows, no pair
of rows is compared.  Directions come from a seed, so training and scoring sets
are mapped alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .train import BINARY_LABEL_META


def scale_gamma(df: DataFrame, features: Sequence[str]) -> float:
    """One over the number of features times the variance of all their values."""
    sums = [f for c in features for f in (F.sum(F.col(f"`{c}`").cast("double")).alias(f"s_{c}"),
                                          F.sum(F.col(f"`{c}`").cast("double") ** 2).alias(f"q_{c}"))]
    t = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = t["n"] * len(features)
    if not n:
        return 1.0
    s, q = (sum(t[f"{k}_{c}"] or 0.0 for c in features) / n for k in "sq")
    return 1.0 / (len(features) * (q - s * s)) if q - s * s > 0 else 1.0


def fourier_features(df: DataFrame, features: Sequence[str], gamma: float, keep: Sequence[str] = (),
                     label: str = "label", size: int = 512, seed: int = 1) -> DataFrame:
    """``keep`` columns, binary ``label`` and ``features``: ``size`` cosines of the row (nulls count as 0)."""
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((len(features), size)) * np.sqrt(2 * gamma)
    phase = rng.uniform(0, 2 * np.pi, size)
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in features])
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.col(label).cast("double").alias("label"), x.alias("_x"))
    schema = StructType([*src.schema.fields[:-1], StructField("_z", ArrayType(DoubleType()))])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                b = whole.slice(i, 1024)
                rows = np.asarray(b.column(b.num_columns - 1).flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                z = np.sqrt(2 / size) * np.cos(rows @ w + phase)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(z), pa.list_(pa.float64()))], names=[*b.schema.names[:-1], "_z"])

    out = src.mapInArrow(mapped, schema)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("label").alias("label", metadata=BINARY_LABEL_META), array_to_vector("_z").alias("features"))
