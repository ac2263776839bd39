"""Whitening of embeddings with covariances by polarisation.

Each component c, as double, becomes the integer ``floor(64 * c) + 1000000``; the fit list holds each distinct
integer vector once. Spark first sums every dimension. Each dimension is then centred at the integer next to its
mean, and the tasks add up exact squares only: of every centred dimension and of every sum of two centred dimensions.
With n vectors, ``n * (sum of squares) - (square of sum)`` is n squared times a variance, in whole numbers, and half
of ``Var(a + b) - Var(a) - Var(b)`` is the covariance of a and b. What reaches the driver is one row per pair of
dimensions, whatever the number of rows; the covariance is assembled there, divided once, and given to ``eigh``.

A component's sign makes its entry of largest size positive. ``identity_error`` is measured: the whitened fit list's
own covariance is summed over all tasks (products in units of 1e-9, so the sum does not depend on the order) and
compared with the identity.

Defined cases: vectors that are null or hold a null or non-finite entry, or an entry whose integer has more than
``DIGITS`` binary digits, take no part; vectors of different lengths (none of length 0) are whitened apart, each
length over its own fit list; a component whose eigenvalue is not above ``FLAT`` times the trace (equal vectors, one
vector, dependent dimensions) has no direction that data give it: its ``whitened`` is null and it is left out of
``identity_error``, which is null where no component is left; ``explained`` is null where the trace is 0. A deviation
outside the range of a long is null. Repeated rows and ids are answered each; an empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import the package

SCALE, SHIFT = 64, 1_000_000
DIGITS = 52
COMPONENTS = 16
FLAT = 1e-12
SMALL = 1 << 22  # centred entries up to this size are squared and summed in 64 bits, a thousand rows at a time
UNIT = 1e9


def integer_vectors(vectors: DataFrame, key: str, value: str) -> DataFrame:
    """``key, x`` with the integer vectors of the rows that take part."""
    scaled = F.transform(F.col(value), lambda c: F.floor(c.cast("double") * SCALE))
    c = F.col(value)
    sound = (F.size(c) > 0) & F.coalesce(F.forall(c, lambda e: F.abs(e.cast("double")) < float(2 ** (DIGITS - 6))), F.lit(False))
    return vectors.filter(c.isNotNull() & sound).select(F.col(key), F.transform(scaled, lambda e: e.cast("long") + SHIFT).alias("x"))


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length in a batch."""
    lists = batch.column(column)
    lengths = np.asarray(lists.value_lengths())
    flat, starts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lengths)[:-1]]
    for dims in sorted(set(lengths.tolist())):
        at = np.flatnonzero(lengths == dims)
        yield dims, at, flat[starts[at][:, None] + np.arange(dims)]


def dimension_sums(fitted: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """``length -> (vectors, sums of the dimensions)``."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims, at, x in _matrices(batch, 0):
                n, sums = held.get(dims, (0, np.zeros(dims, dtype=object)))
                for start in range(0, len(x), 1000):
                    sums = sums + (x[start : start + 1000] - SHIFT).sum(axis=0).astype(object)
                held[dims] = (n + len(at), sums + SHIFT * len(at))
        for dims, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dims] * (dims + 1), pa.int32()),
                    pa.array(range(-1, dims), pa.int32()),
                    pa.array([str(v) for v in [n, *sums]]),
                ],
                names=["dims", "i", "part"],
            )

    parts = fitted.select("x").mapInArrow(summed, "dims int, i int, part string")
    rows = parts.groupBy("dims", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).orderBy("dims", "i").collect()
    found: dict[int, list[int]] = {}
    for r in rows:  # one row per length and dimension
        found.setdefault(r["dims"], []).append(int(r["s"]))
    return {dims: (v[0], v[1:]) for dims, v in found.items()}


def square_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each column of centred integers, and exact sums of squares of each pair (i, j >= i) of columns added up."""
    dims = y.shape[1]
    wide = len(y) and int(np.abs(y).max()) > SMALL
    if wide:
        y = y.astype(object)
    sums, squares = np.zeros(dims, dtype=object), np.zeros(dims * (dims + 1) // 2, dtype=object)
    for start in range(0, len(y), 1000):
        part, out = y[start : start + 1000], []
        for i in range(dims):
            pair = part[:, i:] + part[:, i : i + 1]
            pair[:, 0] = part[:, i]  # a dimension by itself
            out.append((pair * pair).sum(axis=0))
        sums = sums + part.sum(axis=0).astype(object)
        squares = squares + np.concatenate(out).astype(object)
    return sums, squares


def covariances(fitted: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Covariance matrix of each length, by differences of exact variances."""
    centres = {dims: np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64) for dims, (n, sums) in totals.items()}
    low = 10**15

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dims, _, x in _matrices(batch, 0):
                new = square_sums(x - centres[dims])
                old = held.get(dims)
                held[dims] = [a + b for a, b in zip(old, new, strict=True)] if old else list(new)
        for dims, (sums, squares) in held.items():
            i, j = np.triu_indices(dims)
            firsts, seconds = np.r_[np.full(dims, -1), i], np.r_[np.arange(dims), j]
            values = [*sums, *squares]  # in two parts, so that sums over all tasks stay exact
            for start in range(0, len(values), 50_000):
                cut = slice(start, start + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([dims] * len(values[cut]), pa.int32()),
                        pa.array(firsts[cut].astype(np.int32)),
                        pa.array(seconds[cut].astype(np.int32)),
                        pa.array([str(v // low) for v in values[cut]]),
                        pa.array([int(v % low) for v in values[cut]], pa.int64()),
                    ],
                    names=["dims", "i", "j", "high", "low"],
                )

    parts = fitted.select("x").mapInArrow(squared, "dims int, i int, j int, high string, low long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("dims", "i", "j").agg(exact("high"), exact("low")).collect()  # one per pair of dimensions
    sums, squares = {}, {}
    for r in rows:
        whole = int(r["high"]) * low + int(r["low"])
        (sums if r["i"] < 0 else squares)[r["dims"], max(r["i"], 0) if r["i"] >= 0 else 0, r["j"]] = whole
    out = {}
    for dims, (n, _) in totals.items():
        mean = [sums[dims, 0, i] for i in range(dims)]
        single = [n * squares[dims, i, i] - mean[i] ** 2 for i in range(dims)]  # n * n times the variance
        v = np.empty((dims, dims))
        for i in range(dims):
            v[i, i] = single[i] / (n * n)
            for j in range(i + 1, dims):
                both = n * squares[dims, i, j] - (mean[i] + mean[j]) ** 2
                v[i, j] = v[j, i] = (both - single[i] - single[j]) / (2 * n * n)
        out[dims] = v
    return out


def principal_axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as columns, shares of the trace (NaN where it is 0)."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    with np.errstate(invalid="ignore", divide="ignore"):
        return values, vectors, np.where(trace > 0, np.maximum(values, 0.0) / trace, np.nan)


class Axes:
    """What a task needs to whiten vectors of one length."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, components: int) -> None:
        self.n = n
        self.whole = [s // n for s in sums]
        self.rest = np.array([s - n * w for s, w in zip(sums, self.whole, strict=True)], dtype=object)
        values, vectors, self.explained = principal_axes(v, components)
        self.real = values > FLAT * float(np.trace(v))
        self.basis = vectors / np.sqrt(np.where(self.real, values, 1.0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.whole, dtype=np.int64)).astype(np.float64) - (self.rest / self.n).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.basis

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) squared, in whole numbers."""
        off = x - np.array(self.whole, dtype=np.int64)
        reach = (int(np.abs(off).max()) + 1) * self.n if len(off) else 0
        if reach * reach * x.shape[1] < 2**63:
            d = off * self.n - self.rest.astype(np.int64)
        else:
            d = off.astype(object) * self.n - self.rest
        return [int(s) if s < 2**63 else None for s in (d * d).sum(axis=1)]


def identity_errors(fitted: DataFrame, axes: dict[int, Axes]) -> dict[int, float | None]:
    """Largest entry of the fit list's whitened covariance less the identity, for each length."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dims, _, x in _matrices(batch, 0):
                w = axes[dims].whitened(x)[:, axes[dims].real]
                w = np.column_stack([np.ones(len(w)), w])
                i, j = np.triu_indices(w.shape[1])
                for start in range(0, len(w), 1000):
                    part = w[start : start + 1000]
                    new = np.rint(part[:, i] * part[:, j] * UNIT).astype(np.int64).sum(axis=0).astype(object)
                    held[dims] = held.get(dims, 0) + new
        for dims, sums in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dims] * len(sums), pa.int32()),
                    pa.array(range(len(sums)), pa.int32()),
                    pa.array([str(int(v)) for v in sums]),
                ],
                names=["dims", "pair", "part"],
            )

    parts = fitted.select("x").mapInArrow(products, "dims int, pair int, part string")
    rows = parts.groupBy("dims", "pair").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, float | None] = {}
    for dims, a in axes.items():
        size = int(a.real.sum()) + 1
        m = np.zeros((size, size))
        i, j = np.triu_indices(size)
        for r in rows:
            if r["dims"] == dims:
                m[i[r["pair"]], j[r["pair"]]] = m[j[r["pair"]], i[r["pair"]]] = float(r["s"]) / UNIT / a.n
        inner = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) - np.eye(size - 1)
        out[dims] = float(np.abs(inner).max()) if size > 1 else None
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", value: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``; see the module."""
    kind = vectors.schema[key].dataType.simpleString()
    coded = integer_vectors(vectors, key, value)
    fitted = cut_lineage(coded.select("x").distinct())
    totals = dimension_sums(fitted)
    matrices = covariances(fitted, totals)
    axes = {dims: Axes(n, sums, matrices[dims], components) for dims, (n, sums) in totals.items()}
    errors = identity_errors(fitted, axes)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, at, x in _matrices(batch, 1):
                a = axes[dims]
                k = len(a.explained)
                w, flat = a.whitened(x), np.tile(~a.real, len(at))
                again = pa.array(np.repeat(at, k))
                share = np.tile(a.explained, len(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(again),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(at) * k, a.n, dtype=np.int64)),
                        pa.array(a.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(w.ravel(), mask=flat),
                        pa.array(share, mask=np.isnan(share)),
                        pa.array([errors[dims]] * (len(at) * k), pa.float64()),
                    ],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    head = f"`{key}` {kind}, component int, n long, deviation long"
    return coded.mapInArrow(projected, f"{head}, whitened double, explained double, identity_error double")
