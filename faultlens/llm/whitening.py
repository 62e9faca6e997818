"""Whitening of embeddings through spectral divide and conquer.

Entries become integers, every different vector counts once, and sums and sums
of products are exact, so the covariance does not depend on how the rows lie.
Its eigenvectors come from polar decompositions: the orthogonal factor of
``V - s`` has eigenvalue 1 where V's is above the shift s and -1 below, so half
of it plus the identity projects on the upper invariant subspace. Both
subspaces are split again until single components are left. The factor itself
is found by the QR-based dynamically weighted Halley iteration.
The components, a small matrix, then go to all tasks, which project the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.common import store

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest dimension: its square goes to the driver.
DIMENSIONS = 2048
#: Entries beyond this many times 1 / SCALE are not told apart by doubles.
LARGEST = float(1 << 52)
#: Rows multiplied at a time, and bits of a limb: sums of products of limbs stay exact in doubles.
_ROWS, _LIMB = 1 << 12, 20
_EPS = np.finfo(float).eps


def integers(vector: Column) -> Column:
    """floor(SCALE * entry) + SHIFT of every entry; null where the vector or an entry is missing, not finite or beyond ``LARGEST``."""
    good = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * SCALE >= LARGEST))
    return F.when(good, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def exact_sums(fit: DataFrame, dimension: int) -> tuple[int, list[int]]:
    """The number of rows and the sum of every entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(dimension, object)
        for batch in batches:
            rows = _matrix(batch.column(0))
            count += len(rows)
            for k in range(0, len(rows), 512):
                total += rows[k : k + 512].sum(0).astype(object)
        found = [(i, Decimal(int(v))) for i, v in enumerate([*total, count])] if count else []
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int32()), pa.array([v for _, v in found], pa.decimal128(38, 0))], names=["i", "total"])

    # One row for each entry.
    sums = {r["i"]: int(r["total"]) for r in fit.mapInArrow(run, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    return sums.get(dimension, 0), [sums.get(i, 0) for i in range(dimension)]


def _limbs(rows: np.ndarray) -> list[np.ndarray]:
    """Doubles whose sum, each times 2^20 more than the one before, are the given integers."""
    found = []
    while np.abs(rows).max(initial=0) >> _LIMB:
        found.append((rows & ((1 << _LIMB) - 1)).astype(float))
        rows = rows >> _LIMB
    return [*found, rows.astype(float)]


def products(rows: np.ndarray) -> np.ndarray:
    """Exact sums of products of all pairs of columns, as Python integers."""
    total = np.zeros((rows.shape[1], rows.shape[1]), object)
    for k in range(0, len(rows), _ROWS):
        limbs = _limbs(rows[k : k + _ROWS])
        for a, one in enumerate(limbs):
            for b, two in enumerate(limbs):
                total += (one.T @ two).astype(np.int64).astype(object) << _LIMB * (a + b)
    return total


def exact_products(fit: DataFrame, centre: list[int]) -> np.ndarray:
    """Sums over the rows of the products of all pairs of entries, after ``centre`` is taken off; whole numbers."""
    dimension = len(centre)
    upper = np.triu_indices(dimension)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((dimension, dimension), object), np.array(centre, np.int64)
        for batch in batches:
            total += products(_matrix(batch.column(0)) - middle)
        values = pa.array([Decimal(int(v)) for v in total[upper]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), values], names=["i", "j", "total"])

    found = np.zeros((dimension, dimension), object)
    # One row for each pair of entries.
    for r in fit.mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[r["i"], r["j"]] = found[r["j"], r["i"]] = int(r["total"])
    return found


def orthogonal_factor(a: np.ndarray, rounds: int = 16) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix; None if it is singular to working precision."""
    size = len(a)
    alpha = min(np.linalg.norm(a), np.abs(a).sum(0).max())
    if not alpha:
        return None
    x = a / alpha
    try:
        low = 0.9 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        return None
    if not low > 4 * _EPS:
        return None
    for _ in range(rounds):
        square = low * low
        d = (4 * (1 - square) / square**2) ** (1 / 3)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(size)]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:size] @ q[size:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved < 1e-10 and 1 - low < 10 * _EPS:
            return x
    return x if np.linalg.norm(x @ x - np.eye(size)) < 1e-12 * size else None


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Places to cut a spectrum: the mean always lies inside; the others make up for an eigenvalue that sits on one."""
    diagonal = np.diag(a)
    mean, spread = diagonal.mean(), np.linalg.norm(a - diagonal.mean() * np.eye(len(a))) / len(a)
    yield float(np.median(diagonal))
    yield float(mean)
    for k in range(1, 8):
        yield mean + spread * k / 16
        yield mean - spread * k / 16


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the upper invariant subspace, and their number.

    None if the matrix is a multiple of the identity to working precision.
    """
    size = len(a)
    if np.linalg.norm(a - np.diag(a).mean() * np.eye(size)) <= _EPS * scale:
        return None
    best = None
    for shift in _shifts(a):
        factor = orthogonal_factor(a - shift * np.eye(size))
        if factor is None:
            continue
        projector = (factor + np.eye(size)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < size:
            continue
        basis = projector @ np.random.default_rng(size).standard_normal((size, rank))
        for _ in range(2):
            basis = projector @ np.linalg.qr(basis)[0]
        basis = np.linalg.qr(basis, mode="complete")[0]
        rest = np.linalg.norm(basis[:, rank:].T @ a @ basis[:, :rank])
        if best is None or rest < best[0]:
            best = rest, basis, rank
        if rest <= 8 * size * _EPS * scale:
            break
    return best and best[1:]


def components(a: np.ndarray, wanted: int, scale: float | None = None) -> np.ndarray:
    """Unit eigenvectors (columns) of the ``wanted`` largest eigenvalues of a symmetric matrix, or all if there are fewer.

    The lower subspace is entered only for what the upper one does not give.
    """
    scale = np.linalg.norm(a) if scale is None else scale
    if len(a) <= 1:
        return np.eye(len(a))[:, :wanted]
    found = split(a, scale)
    if found is None:
        return np.eye(len(a))[:, :wanted]
    basis, rank = found
    parts = []
    for half in (basis[:, :rank], basis[:, rank:]):
        left = wanted - sum(p.shape[1] for p in parts)
        if left > 0:
            inner = half.T @ a @ half
            parts.append(half @ components((inner + inner.T) / 2, left, scale))
    return np.hstack(parts)


class Whitening(NamedTuple):
    """What is fitted: rows and exact sums, the eigenvectors (columns) with their eigenvalues, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def centre(self) -> list[int]:
        """The whole part of the mean."""
        return [s // self.n for s in self.sums]

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Whitened rows; the whole part of the mean is taken off as integers, so no digit is lost."""
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((rows - np.array(self.centre, np.int64)) - rest) @ self.vectors / np.sqrt(self.values)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums over the entries of (n * x - S)^2, exact; None beyond 63 bits."""
        rows = rows - np.array(self.centre, np.int64)
        rest = [s % self.n for s in self.sums]
        if rows.size and rows.shape[1] * (self.n * (int(np.abs(rows).max()) + 1)) ** 2 >= 1 << 63:
            exact = ((rows.astype(object) * self.n - np.array(rest, object)) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in exact]
        return ((rows * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()


def fitted(fit: DataFrame, dimension: int, wanted: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table of different integer vectors ``x``; None if no row or no variance is there.

    Components whose eigenvalue is nought to working precision are left out.
    """
    n, sums = exact_sums(fit, dimension)
    if not n:
        return None
    centre, rest = [s // n for s in sums], np.array([s % n for s in sums], object)
    exact = exact_products(fit, centre) * n - np.outer(rest, rest)
    covariance = np.array([[int(v) / (n * n) for v in row] for row in exact])
    trace = int(np.trace(exact)) / (n * n)
    vectors = components(covariance, wanted)
    values = np.einsum("ij,ij->j", vectors, covariance @ vectors)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > dimension * _EPS * trace]
    return Whitening(n, sums, vectors[:, order], values[order], trace) if len(order) else None


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    size = len(whitening.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            rows = whitening.project(_matrix(batch.column(0)))
            total += np.c_[rows.T @ rows, rows.sum(0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["at", "total"])

    # A row for each pair of components, and their sums.
    found = np.zeros(size * (size + 1))
    for r in fit.mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect():
        found[r["at"]] = r["total"]
    found = found.reshape(size, size + 1) / whitening.n
    return float(np.abs(found[:, :size] - np.outer(found[:, size], found[:, size]) - np.eye(size)).max())


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened_embeddings(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector and component.

    A vector is usable if it is not null, no entry is null, not finite or
    beyond ``LARGEST``, and it has as many entries as most different usable
    vectors (of equally frequent lengths the longer). Repeated rows give
    repeated results and count once in the fit; a null vec_id stays null. There
    are fewer than ``wanted`` components where fewer have any variance, and no
    row for an empty table, a single different vector or vectors without
    entries. ``deviation`` is null beyond 63 bits. Other columns are not looked at.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).filter("x IS NOT NULL AND size(x) > 0")
    different = store(rows.select("x").distinct(), "vectors")
    lengths = different.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dimension = lengths[0]["size"] if lengths else 0
    if dimension > DIMENSIONS:
        raise ValueError(f"vectors of {dimension} entries; at most {DIMENSIONS} are whitened")
    fit = different.filter(F.size("x") == dimension)
    whitening = fitted(fit, dimension, wanted) if dimension else None
    if whitening is None:
        return spark.createDataFrame([], _OUT)
    error, size = identity_error(fit, whitening), len(whitening.values)
    explained = whitening.values / whitening.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, _ROWS) for k in range(0, batch.num_rows, _ROWS)):
                x, count = _matrix(part.column(1)), part.num_rows
                places = np.repeat(np.arange(count), size)
                columns = [
                    part.column(0).take(pa.array(places)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, whitening.n, np.int64)),
                    pa.array(whitening.deviations(x), pa.int64()).take(pa.array(places)),
                    pa.array(whitening.project(x).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.filter(F.size("x") == dimension).mapInArrow(run, _OUT)
