"""Operator 12, embedding whitening: polarisation covariance.

Entries become integers (``floor(SCALE * c) + SHIFT``); the fit list holds every distinct integer vector once.
One pass sums each dimension.  The next centres every vector at the integer below its mean and sums the exact
squares of each dimension and of each sum of two dimensions.  With the remainders of the means these give the
exact variances, and

    cov(a, b) = (var(a + b) - var(a) - var(b)) / 2

recovers every covariance from differences of variances, in whole numbers over ``2 n^2``.  Only the finished
matrix is rounded to doubles for ``eigh``.  The driver and every task hold numbers by dimension or by pair of
dimensions, never vectors.

Sums stay exact at any size: squares are added in 64-bit integers while the batch's largest entry allows it and
in Python integers otherwise, then in decimals of 38 digits.

Edge cases: rows with a null vector, or one that holds nulls, non-finite numbers or entries whose integer does not
fit 62 bits, take no part, nor do empty vectors and vectors of another length than most (ties: the shorter);
a null id is an id like others and repeated rows each get their result; components whose eigenvalue is zero to
rounding (fewer distinct vectors than dimensions, constant dimensions) are left out, so one distinct vector or
an empty table gives no rows; a deviation beyond 64 bits is null as long, exact in ``deviation_exact``; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
ROWS = 2048  # vectors of one step inside a task
SAFE = 1 << 25  # squares of sums of two such entries, times ROWS, fit 64 bits
WHOLE = pa.decimal128(38, 0)


def _integers(col: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a column as rows of integers, some at a time."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    for lo in range(0, len(col), ROWS):
        some = col.slice(lo, ROWS)
        yield some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(some), -1)


def _numbers(values: list) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], WHOLE)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of each dimension, and the number of vectors, of one task."""
    total, n = None, 0
    for batch in batches:
        for x in _integers(batch.column(0)):
            own = x.sum(0) if np.abs(x).max(initial=0) < 1 << 50 else x.astype(object).sum(0)
            total, n = own.astype(object) + (0 if total is None else total), n + len(x)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64()), _numbers(total)],
                                         names=["dim", "n", "total"])


def polarised(y: np.ndarray) -> np.ndarray:
    """Sums of squares of each dimension (diagonal) and of each sum of two (above it) of centred vectors."""
    if np.abs(y).max(initial=0) >= SAFE:
        y = y.astype(object)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(y.shape[1]):
        pair = y[:, a:a + 1] + y[:, a:]
        out[a, a:] = (pair * pair).sum(0)
        out[a, a] = (y[:, a] * y[:, a]).sum()
    return out


def _squares(batches: Iterator[pa.RecordBatch], centre: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for x in _integers(batch.column(0)):
            own = polarised(x - centre)
            total = own if total is None else total + own
    if total is not None:
        a, b = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), _numbers(total[a, b])], names=["a", "b", "squares"])


class Fit:
    """What the fit list says: ``n``, integer centres and remainders of the means, covariance, components."""

    def __init__(self, n: int, sums: list[int], squares: dict[tuple[int, int], int] | None = None) -> None:
        self.n, self.sums = n, sums
        self.centre = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
        self.rest = [s % n for s in sums] if n else []
        if squares is not None:
            self.solve(squares)

    def solve(self, squares: dict[tuple[int, int], int]) -> None:
        dims, n, rest = len(self.sums), self.n, self.rest
        var = [n * squares[a, a] - rest[a] ** 2 for a in range(dims)]  # n^2 times the variance
        cov = np.zeros((dims, dims))
        for (a, b), q in squares.items():
            twice = 2 * var[a] if a == b else n * q - (rest[a] + rest[b]) ** 2 - var[a] - var[b]
            cov[a, b] = cov[b, a] = float(Fraction(twice, 2 * n * n))
        value, vector = np.linalg.eigh(cov)
        value, vector = value[::-1], vector[:, ::-1]
        self.cov, self.trace = cov, float(Fraction(sum(var), n * n))
        real = value > value[:1].max(initial=0) * dims * np.finfo(float).eps
        self.value, self.vector = value[real][:COMPONENTS], vector[:, real][:, :COMPONENTS]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of integer vectors."""
        mean_rest = np.array([float(Fraction(r, self.n)) for r in self.rest])
        return ((x - self.centre).astype(float) - mean_rest) @ (self.vector / np.sqrt(self.value))

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of ``(n x - S)^2``, by vector: centred entries and remainders are
        multiplied in small integers, the rest is one sum for each vector."""
        y = x - self.centre
        small = np.abs(y).max(initial=0) < SAFE and len(self.rest) * self.n * SAFE < 1 << 62
        y = y if small else y.astype(object)
        square, cross = (y * y).sum(1), (y * np.array(self.rest, np.int64 if small else object)).sum(1)
        own = sum(r * r for r in self.rest)
        return [self.n ** 2 * int(a) - 2 * self.n * int(b) + own for a, b in zip(square, cross, strict=True)]


def _moments(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """Sums of the whitened components and of their products over part of the fit list."""
    total = None
    for batch in batches:
        for x in _integers(batch.column(0)):
            w = fit.project(x)
            w = np.hstack([w, np.ones((len(w), 1))])
            total = w.T @ w + (0 if total is None else total)
    if total is not None:
        a, b = np.triu_indices(len(total))
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], names=["a", "b", "moment"])


def _whitened(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for x in _integers(batch.column(1)):
            ids, w = batch.column(0).slice(at, len(x)), fit.project(x)
            at += len(x)
            yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), w.shape[1]).cast(pa.list_(pa.float64())),
                                              _numbers(fit.deviations(x))], names=["vec_id", "whitened", "deviation_exact"])


def _to_integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that have a vector of whole, finite entries, as integers."""
    for batch in batches:
        col = batch.column(1)
        size = np.asarray(col.value_lengths().fill_null(0))
        entry = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is not a number
        row = np.repeat(np.arange(len(col)), size)
        good = size > 0
        good[row[~(np.abs(entry) < (1 << 62) / SCALE)]] = False
        x = np.floor(SCALE * entry[good[row]]).astype(np.int64) + SHIFT
        edge = np.append(0, np.cumsum(size[good])).astype(np.int32)
        ids = batch.column(0).filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(edge), pa.array(x))], names=["vec_id", "x"])


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and the integer vector ``x`` of the rows that take part, written once."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    rows = staged(own.mapInArrow(_to_integers, f"vec_id {dict(own.dtypes)['vec_id']}, x array<long>"), "whitening-rows")
    sizes = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    return rows.filter(F.size("x") == sizes[0]["n"]) if len(sizes) > 1 else rows


def fitted(distinct: DataFrame) -> Fit:
    """Sums, polarised squares and components of the distinct integer vectors (column ``x``)."""
    sums = distinct.mapInArrow(_sums, "dim int, n long, total decimal(38,0)").groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    fit = Fit(sums[0]["n"] if sums else 0, [int(r["total"]) for r in sums])
    if sums:
        pairs = distinct.mapInArrow(partial(_squares, centre=fit.centre), "a int, b int, squares decimal(38,0)")
        fit.solve({(r["a"], r["b"]): int(r["squares"]) for r in pairs.groupBy("a", "b").agg(F.sum("squares").alias("squares")).collect()})
    return fit


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    found = distinct.mapInArrow(partial(_moments, fit=fit), "a int, b int, moment double")
    k = len(fit.value)
    m = np.zeros((k + 1, k + 1))
    for r in found.groupBy("a", "b").agg(F.sum("moment").alias("moment")).collect():
        m[r["a"], r["b"]] = m[r["b"], r["a"]] = r["moment"] / fit.n
    return float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, Fit, float]:
    """One row for each vector (``vec_id``, ``whitened`` array, ``deviation_exact``), the fit and its error."""
    rows = integer_vectors(vectors, id_col, vector_col)
    distinct = staged(rows.select("x").distinct(), "whitening-fit")
    fit = fitted(distinct)
    if not fit.n or not len(fit.value):
        return rows.limit(0).select("vec_id", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("decimal(38,0)").alias("deviation_exact")), fit, 0.0
    done = rows.mapInArrow(partial(_whitened, fit=fit), f"vec_id {dict(rows.dtypes)['vec_id']}, whitened array<double>, deviation_exact decimal(38,0)")
    return done, fit, identity_error(distinct, fit)


def op12(embeddings: DataFrame) -> DataFrame:
    rows, fit, error = whiten(embeddings, "vec_id", "embedding")
    share = [float(e) / fit.trace for e in fit.value] if fit.n else []
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return rows.select("vec_id", "deviation_exact", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"),
        F.when(F.col("deviation_exact") <= most, F.col("deviation_exact")).cast("long").alias("deviation"), "whitened",
        F.element_at(F.array(*map(F.lit, share)).cast("array<double>"), F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_exact")
