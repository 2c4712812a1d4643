"""Co-moments of many columns in one pass, and what follows from them.

A task multiplies its rows' matrix with itself, so one pass over the rows gives the
sums of products of all pairs of columns: correlation matrix, covariance,
standardisation and principal components are arithmetic on these.  Nulls and NaN
leave out a row for the pairs they are in, as SQL's ``corr`` does.  Columns are
shifted by a rough mean first, so that large means cost no digits.  A task hands on
``columns ** 2`` numbers, and parts are merged to at most ``stepwise.MERGE`` before they reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stepwise import merged_sum


@dataclass
class CoMoments:
    """Per pair (i, j), over the rows where both are known: ``n`` rows, ``s`` the sum
    of column i, ``q`` of its squares, ``p`` of the products; all about ``shift``."""

    columns: list[str]
    shift: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    p: np.ndarray
    constant: np.ndarray

    def means(self) -> np.ndarray:
        return np.where(np.diag(self.n) > 0, self.shift + np.diag(self.s) / np.maximum(np.diag(self.n), 1), np.nan)

    def covariance(self) -> np.ndarray:
        """Sample covariance of every pair; NaN below two rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.n > 1, (self.p - self.s * self.s.T / self.n) / (self.n - 1), np.nan)

    def correlation(self) -> np.ndarray:
        """Pearson correlation of every pair; NaN where a column does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self.q - self.s ** 2 / self.n
            out = (self.p - self.s * self.s.T / self.n) / np.sqrt(np.maximum(spread, 0) * np.maximum(spread.T, 0))
        out[self.constant] = np.nan
        out[:, self.constant] = np.nan
        return np.where(np.isfinite(out), np.clip(out, -1, 1), np.nan)

    def components(self, k: int, standardised: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(k variances, k directions as rows) of the principal components; the largest
        coordinate of a direction is positive."""
        m = self.correlation() if standardised else self.covariance()
        values, vectors = np.linalg.eigh(np.nan_to_num(m))
        order = np.argsort(-values, kind="stable")[:k]
        rows = vectors[:, order].T
        signs = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)])
        return values[order], rows * signs[:, None]


def comoments(df: DataFrame, columns: Sequence[str]) -> CoMoments:
    """Co-moments of numeric columns: a pass for the rough means and ranges, one for the products."""
    columns = list(columns)
    src = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    fine = [F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i in range(len(columns))]
    ends = src.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(fine) for n, f in (("a", F.avg), ("l", F.min), ("h", F.max))]).first()
    shift = np.array([ends[f"a{i}"] if ends[f"a{i}"] is not None else 0.0 for i in range(len(columns))])
    constant = np.array([ends[f"l{i}"] is None or ends[f"l{i}"] == ends[f"h{i}"] for i in range(len(columns))])
    k = len(columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]) - shift
            known = (~np.isnan(x)).astype(np.float64)
            x = np.where(known > 0, x, 0.0)
            total += [known.T @ known, x.T @ known, (x ** 2).T @ known, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    n, s, q, p = merged_sum(src.mapInArrow(partial, "s binary"), 4 * k * k).reshape(4, k, k)
    return CoMoments(columns, shift, n, s, q, p, constant)


def correlation_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Full correlation matrix, long: ``a, b, corr`` (null where a column does not vary)."""
    m = comoments(df, columns).correlation()
    rows = [(a, b, None if np.isnan(m[i, j]) else float(m[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def project(df: DataFrame, columns: Sequence[str], k: int, keep: Sequence[str] = (), standardised: bool = True) -> DataFrame:
    """``keep`` columns and ``components``: the row's principal components, centred (nulls at the mean)."""
    about = comoments(df, columns)
    mean = np.nan_to_num(about.means())
    std = np.sqrt(np.nan_to_num(np.diag(about.covariance())))
    scale = np.where((std > 0) & ~about.constant, std, 1.0) if standardised else np.ones(len(std))
    _, rows = about.components(k, standardised)
    z = [(F.coalesce(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), F.lit(float(m))) - float(m)) / float(d)
         for c, m, d in zip(columns, mean, scale, strict=True)]
    x = F.array(*z)
    dots = [F.aggregate(F.zip_with(F.col("_x"), F.array(*[F.lit(float(v)) for v in r]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) for r in rows]
    return df.select(*[F.col(f"`{c}`") for c in keep], x.alias("_x")).select(*[F.col(f"`{c}`") for c in keep], F.array(*dots).alias("components"))
