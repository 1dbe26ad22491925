"""Whitening of embeddings by a randomised range finder and Rayleigh-Ritz.

Entries become whole numbers, floor(SCALE * c) + SHIFT, and sums are exact. A pass over
all rows multiplies the covariance with a few columns: each task centres its rows, then
multiplies, and gives one small matrix; the matrices are added by position in a shuffle.
The range finder starts with random columns (COMPONENTS and OVERSAMPLE more) and repeats
such passes; the last columns, made orthonormal, are a basis, and Rayleigh-Ritz in it
gives values and vectors. The same pass gives their residuals. Where one is over
TOLERANCE of the greatest value, as with spectra whose values lie close, the basis
is expanded to the full dimension and one more pass gives all components to double precision.

What comes to the driver, or is sent from it, is a matrix of at most dimension x dimension numbers,
whatever the rows. The quantised rows are written to the shared folder once and read by every pass.

A vector is left out if it is null or holds a null or non-finite entry. Vectors of fewer entries than
the longest have zeros for the rest. Entries are held to +-LARGEST, so that sums and products
stay exact; a deviation that a long can't hold is null. A component without variance (to rounding)
has null for `whitened` and isn't part of `identity_error`; `explained` is 0 where nothing varies. Every
row counts, repeated and null ids too. An empty table, or only empty vectors, gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
OVERSAMPLE = 8
PASSES = 4
TOLERANCE = 1e-12
LARGEST = 1 << 52
LONG = (1 << 63) - 1


def quantised(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(i, x): id and whole-number entries of every usable vector."""
    vector = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = rows.select(F.col(id_col).alias("i"), vector.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    bound = float(LARGEST)
    return good.select("i", F.transform("v", lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-bound)), F.lit(bound))) + SHIFT).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a batch as rows of int64, the shorter ones filled up."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.full((len(size), dim), SHIFT, np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def total(rows: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what `of` gives for the matrix of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                mine += of(matrix(batch.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array([mine.ravel()], pa.list_(pa.float64()))], names=["m"])

    parts = rows.select("x").mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("at", "v"))
    out = np.zeros(int(np.prod(shape)))
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def sums(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Number of rows, greatest dimension, exact sums of each dimension."""
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not dim:
        return n, dim, []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = [0] * dim, [0] * dim
        for batch in batches:
            x = matrix(batch.column(0), dim)
            # two halves of 27 bits or so, whose sums over a batch stay in 64
            high = [a + int(b) for a, b in zip(high, (x >> 27).sum(0))]
            low = [a + int(b) for a, b in zip(low, (x & ((1 << 27) - 1)).sum(0))]
        whole = [(a << 27) + b for a, b in zip(high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([str(s) for s in whole], pa.string())], names=["at", "s"])

    parts = rows.select("x").mapInArrow(run, "at int, s string")
    found = {r["at"]: int(r["s"]) for r in parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return n, dim, [found[k] for k in range(dim)]


@dataclass
class Whitening:
    """Rows, sums of each dimension, and components as columns, by falling variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    full: bool  # the basis had to be expanded

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def real(self) -> np.ndarray:
        """Which components vary, beyond rounding."""
        return self.variances > 4 * len(self.sums) * np.finfo(float).eps * max(0.0, self.variances.max(initial=0.0))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows over the root of the variance; 0 where nothing varies."""
        scale = np.where(self.real, 1 / np.sqrt(np.where(self.real, self.variances, 1)), 0.0)
        return (x - self.mean) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - sum) ** 2, in Python's integers where 64 bits might not do."""
        most = max(self.n * float(np.abs(x).max(initial=0)), *[abs(float(s)) for s in self.sums])
        if len(self.sums) * (2 * most) ** 2 < LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        near = self.n * (x.astype(float) - self.mean)
        if self.n * float(np.abs(x).max(initial=0)) + max(abs(float(s)) for s in self.sums) < LONG / 2 and ((near * near).sum(1) < LONG / 2).all():
            d = self.n * x - np.array(self.sums, np.int64)  # each fits, and so do their squares
            return (d * d).sum(1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e <= LONG else None for e in exact]


def fit(rows: DataFrame, count: int = COMPONENTS, seed: int = 13) -> Whitening | None:
    """From rows of quantised(); None where there is nothing to fit."""
    n, dim, exact = sums(rows)
    if not n or not dim:
        return None
    mean = np.array([s / n for s in exact])

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times basis, and the covariance's trace, by one pass over the rows."""

        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.append((c.T @ (c @ basis)).ravel(), np.vdot(c, c))

        out = total(rows, dim, of, (basis.size + 1,))
        return out[:-1].reshape(basis.shape) / n, float(out[-1]) / n

    def ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        small = basis.T @ image
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
        axes = basis @ vectors
        return np.maximum(values, 0), axes / np.linalg.norm(axes, axis=0), float(np.abs(image @ vectors - axes * values).max())

    rng = np.random.default_rng(seed)
    width = min(dim, count + OVERSAMPLE)
    basis = np.linalg.qr(rng.normal(size=(dim, width)))[0]
    for _ in range(PASSES):
        image, trace = product(basis)
        values, axes, residual = ritz(basis, image)
        if residual <= TOLERANCE * values[0] or width == dim:
            break
        basis = np.linalg.qr(image)[0]
    full = residual > TOLERANCE * values[0] and width < dim
    if full:
        basis = np.linalg.qr(np.hstack([basis, rng.normal(size=(dim, dim - width))]))[0]
        image, trace = product(basis)
        values, axes, _ = ritz(basis, image)
    return Whitening(n, exact, axes, values, trace, full)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Greatest absolute entry of the whitened rows' covariance minus the identity."""
    dim, k = model.axes.shape
    mean = total(rows, dim, lambda x: model.apply(x).sum(0), (k,)) / model.n

    def of(x: np.ndarray) -> np.ndarray:
        z = model.apply(x) - mean
        return z.T @ z

    off = total(rows, dim, of, (k, k)) / model.n - np.eye(k)
    off = off[np.ix_(model.real, model.real)]
    return float(np.abs(off).max(initial=0.0))


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component: id, component (from 1), n, deviation (sum of
    (n * x - S) ** 2), whitened, explained, identity_error (one value)."""
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    known = written(quantised(rows, id_col, vec_col), "whitening")
    model = fit(known, count)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast((model, identity_error(known, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, error = sent.value
        dim, k = fitted.axes.shape
        share = fitted.variances / fitted.trace if fitted.trace > 0 else np.zeros(k)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            each = np.repeat(np.arange(len(x)), k)
            z = fitted.apply(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), fitted.n), pa.int64()),
                    pa.array(fitted.deviations(x), pa.int64()).take(pa.array(each)), pa.array(z.ravel(), pa.float64(), mask=~np.tile(fitted.real, len(x))),
                    pa.array(np.tile(share, len(x)), pa.float64()), pa.array(np.full(len(each), error), pa.float64()),
                ],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return known.mapInArrow(run, schema)
