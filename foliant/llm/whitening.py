"""Embedding whitening (13): Welford's rank-one updates in partition iterators, merged by the parallel formula, then a symmetric
QR eigen-solve.

1. A task streams its vectors and holds one state: count, exact sums, mean and the sum of centred outer products. Each vector is
   one rank-one update. States (one narrow row of d + d*(d+1)/2 numbers a task) are merged in rounds of FAN by the parallel update
   formula, so that neither a task nor the driver ever sees more than one of them beside its own.
2. The driver solves the d x d covariance: Householder reflections to a tridiagonal matrix, then implicit QR steps with
   Wilkinson's shifts. Only this one matrix, whose size depends on the dimension alone, reaches it.
3. The components go to the tasks, which project (n*x - S) / n. A second pass of the same kind over the whitened values, whose
   states have one row for each component, gives the covariance that the result reports as its error.

Entries are put on a grid, x = floor(1024 * c) + 100000, so that sums and deviations are exact whole numbers.

Defined results. Vectors that are null or hold a null or non-finite entry are left out. So are vectors whose length isn't the
commonest among the remaining ones (on a tie, the longest of them), as they have no covariance with the others, and empty ones.
Entries whose x passes 2**62 are held at that bound. Equal rows count and are returned each. Components with no variance (at most
1e-13 of the largest) have whitened values of 0 and don't count for the error. An empty table gives an empty result. A deviation
that passes 64 bits is null in `deviation` and stands in `deviation_wide`, which is null otherwise. Further columns of any name
stay in `whitened`; the vectors' own lengths bound memory: a task holds one batch, and one matrix of the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

#: The grid's steps in 1 and its offset; states merged by one task; components returned.
STEPS, OFFSET, FAN, COMPONENTS = 1024, 100_000, 32, 8
#: Part of the largest eigenvalue up to which a component has no variance.
NO_VARIANCE = 1e-13
STATE = "n long, sums string, mean array<double>, products array<double>"


class State:
    """Count, exact sums, mean and centred products of the vectors seen."""

    def __init__(self, d: int):
        self.n, self.sums, self.mean, self.products = 0, [0] * d, np.zeros(d), np.zeros((d, d))

    def add(self, xs: np.ndarray) -> None:
        """One rank-one update for each row; whole numbers are summed exactly too."""
        for x in xs.astype(np.float64):
            self.n += 1
            delta = x - self.mean
            self.mean += delta / self.n
            self.products += np.multiply.outer(delta, x - self.mean)
        if len(xs) and xs.dtype.kind == "i":
            wide = int(np.abs(xs).max()) >= 2**62 // len(xs)
            self.sums = [a + int(b) for a, b in zip(self.sums, (xs.astype(object) if wide else xs).sum(axis=0), strict=True)]

    def merge(self, n: int, sums: list[int], mean: np.ndarray, products: np.ndarray) -> None:
        """The parallel update formula."""
        if not n:
            return
        total, delta = self.n + n, mean - self.mean
        self.products += products + np.multiply.outer(delta, delta) * (self.n / total * n)
        self.mean += delta * (n / total)
        self.n, self.sums = total, [a + b for a, b in zip(self.sums, sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / 2 / self.n

    def row(self) -> pa.RecordBatch:
        upper = self.products[np.triu_indices(len(self.mean))]
        return pa.RecordBatch.from_pydict({"n": [self.n], "sums": [" ".join(map(str, self.sums))], "mean": [self.mean.tolist()], "products": pa.array([upper.tolist()], pa.list_(pa.float64()))})


def merged(batches: Iterator[pa.RecordBatch], d: int) -> State:
    out = State(d)
    for batch in batches:
        for i in range(batch.num_rows):
            r = {name: batch.column(name)[i] for name in ("n", "sums", "mean", "products")}
            full = np.zeros((d, d))
            full[np.triu_indices(d)] = r["products"].values.to_numpy()
            full += np.triu(full, 1).T
            out.merge(r["n"].as_py(), [int(x) for x in r["sums"].as_py().split()], r["mean"].values.to_numpy(), full)
    return out


def state_of(rows: DataFrame, d: int, whole: Callable[[pa.Array], np.ndarray]) -> State:
    """The state of all rows of one array column: one for each task, then merged FAN at a time."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = State(d)
        for batch in batches:
            state.add(whole(batch.column(0)))
        if state.n:
            yield state.row()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = merged(batches, d)
        if state.n:
            yield state.row()

    states, left = rows.mapInArrow(scanned, STATE), rows.rdd.getNumPartitions()
    while left > 1:
        left = math.ceil(left / FAN)
        states = states.repartition(left).mapInArrow(joined, STATE)
    return merged(iter(states.toArrow().to_batches()), d)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: the diagonal, the one beside it, and q with a = q t q'."""
    a, q = a.copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        if (length := np.linalg.norm(v)) == 0:
            continue
        v /= length
        a[k + 1 :] -= 2 * np.multiply.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.multiply.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns: implicit QR steps on the tridiagonal form."""
    scale = float(np.abs(a).max()) or 1.0
    d, e, q = tridiagonal(a / scale)
    vectors, end, eps = np.ascontiguousarray(q.T), len(d) - 1, np.finfo(float).eps
    while end > 0:
        if abs(e[end - 1]) <= eps * (abs(d[end - 1]) + abs(d[end])) or abs(e[end - 1]) < 1e-300:
            e[end - 1], end = 0.0, end - 1
            continue
        start = end - 1
        while start > 0 and abs(e[start - 1]) > eps * (abs(d[start - 1]) + abs(d[start])):
            start -= 1
        half = (d[end - 1] - d[end]) / 2
        shift = d[end] - e[end - 1] ** 2 / (half + math.copysign(math.hypot(half, e[end - 1]), half))
        x, z = d[start] - shift, e[start]
        for k in range(start, end):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > start:
                e[k - 1] = r
            first, second, beside = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * first + 2 * c * s * beside + s * s * second, s * s * first - 2 * c * s * beside + c * c * second
            e[k] = c * s * (second - first) + (c * c - s * s) * beside
            if k < end - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            vectors[k], vectors[k + 1] = c * vectors[k] + s * vectors[k + 1], c * vectors[k + 1] - s * vectors[k]
    order = np.argsort(-d, kind="stable")
    return d[order] * scale, vectors[order].T


class Whitening(NamedTuple):
    """What whitening learns: count, exact sums, eigenvalues (falling), components as columns, trace, error of the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float


def usable(v: Column) -> Column:
    """Neither null nor empty, and all entries finite."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def on_grid(column: pa.Array, d: int) -> np.ndarray:
    """Vectors of length d as rows of whole numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    limit = 2.0**62
    return np.clip(np.floor(STEPS * c), -limit, limit).astype(np.int64) + OFFSET


def centred(xs: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, exact: as 64-bit numbers where their squares' sums fit, else as Python's."""
    most = int(np.abs(xs).max()) if len(xs) else 0
    bound = n * most + max(map(abs, sums))
    if bound < 2**62:
        out = xs * n - np.array(sums, np.int64)
        return out if int(np.abs(out).max(initial=0)) ** 2 * xs.shape[1] < 2**63 else out.astype(object)
    return xs.astype(object) * n - np.array(sums, object)


def projected(off: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    """(x - S/n) on the first k components, over the roots of their eigenvalues."""
    values = model.values[:k]
    kept = values > max(NO_VARIANCE * float(model.values[0]), 0.0)
    roots = np.sqrt(np.where(kept, values, 1.0))
    return np.where(kept, (off.astype(np.float64) / model.n) @ model.components[:, :k] / roots, 0.0)


def fit(vectors: DataFrame, column: str, k: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """What is learned of all usable vectors (None if there are none), and these rows."""
    rows = vectors.where(usable(F.col(f"`{column}`")))
    lengths = rows.groupBy(F.size(f"`{column}`").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return None, rows
    d = lengths[0]["d"]
    rows = rows.where(F.size(f"`{column}`") == d)
    only = rows.select(F.col(f"`{column}`").cast("array<double>").alias("v"))
    state = state_of(only, d, lambda c: on_grid(c, d))
    covariance = state.covariance()
    values, components = symmetric_qr(covariance)
    model = Whitening(state.n, state.sums, values, components, float(np.trace(covariance)), 0.0)
    k = min(k, d)

    def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = projected(centred(on_grid(batch.column(0), d), model.n, model.sums), model, k)
            yield pa.RecordBatch.from_pydict({"w": pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64()))})

    spread = state_of(only.mapInArrow(values_of, "w array<double>"), k, lambda c: c.flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
    off = np.abs(spread.covariance() - np.eye(k))[np.ix_(*[values[:k] > NO_VARIANCE * float(values[0])] * 2)]
    return model._replace(identity_error=float(off.max(initial=0.0))), rows


def whitened(vectors: DataFrame, column: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The usable rows with a struct column `white` (deviation, deviation_wide, whitened), and the model."""
    model, rows = fit(vectors, column, k)
    out = free_name(vectors, "white")
    kind = "struct<deviation:long,deviation_wide:decimal(38,0),whitened:array<double>>"
    if model is None:
        return rows.withColumn(out, F.lit(None).cast(kind)), None
    d, k = len(model.sums), min(k, len(model.sums))

    def measure(column: pa.Array) -> pa.Array:
        off = centred(on_grid(column, d), model.n, model.sums)
        total = [int(x) for x in (off * off).sum(axis=1)]
        w = projected(off, model, k)
        return pa.StructArray.from_arrays([
            pa.array([x if x < 2**63 else None for x in total], pa.int64()),
            pa.array([Decimal(x) if 2**63 <= x < 10**38 else None for x in total], pa.decimal128(38, 0)),
            pa.FixedSizeListArray.from_arrays(pa.array(w.ravel()), k).cast(pa.list_(pa.float64())),
        ], ["deviation", "deviation_wide", "whitened"])

    measure.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return rows.withColumn(out, F.arrow_udf(measure, kind)(F.col(f"`{column}`").cast("array<double>"))), model


def whitening_query(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component."""
    rows, model = whitened(vectors.select("vec_id", "embedding"))
    explained = [float(x) / model.trace if model.trace else 0.0 for x in model.values[:COMPONENTS]] if model else []
    each = rows.select("vec_id", "white.deviation", "white.deviation_wide", F.posexplode("white.whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast(T.IntegerType()).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, explained)).cast("array<double>"), F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"), "deviation_wide",
    )
