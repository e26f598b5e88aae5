"""Operator 11: principal components of embeddings by spectral divide and conquer, and whitening.

Entries become whole numbers on a fixed grid, so counts, sums and cross products over all vectors are exact
and do not depend on the order of tasks.  Cross products are of distances from the whole number next to each
mean; what is left of the mean is taken off exactly, so the covariance is the rounded true one.

The eigenvectors come from polar decompositions alone.  The polar factor U of V - shift * I (found by dynamically
weighted Halley steps, with a QR factorisation while the weights are large and a Cholesky one after) has
the eigenvalues 1 and -1, so (I + U) / 2 projects on the space of all eigenvalues above the shift.  A basis of
that space and one of its complement cut V into two smaller symmetric matrices, and so on until each
is a single number or a multiple of the identity.  The matrix is of the vectors' dimension, whatever their
number; this part runs on the driver, and d x 16 numbers go to the tasks that whiten.

Defined results: rows with a null vector, a null or non-finite entry are dropped.  So are vectors of another
length than most (of equally frequent lengths, the longest counts).  Equal vectors count once in the fit, and each
row has its results.  Components whose eigenvalue is not above 1e-12 of the largest have no whitened form and
are left out, so a single vector, or an empty table, gives no rows.  vec_id may be null or repeated.  Entries that
do not fit a whole number of 64 bits on the grid, and deviations that do not, raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deklara.llm.common import column, materialise, remove

_EPS = float(np.finfo(float).eps)
#: A sum is kept as high * 2**_LOW + low, so that sums of any number of vectors are exact.
_LOW = 40
_EXACT = 1 << 53


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that is not singular to working precision."""
    d = len(a)
    eye = np.eye(d)
    x = a / max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    least = max(1 / max(float(np.linalg.norm(np.linalg.inv(x), 1)), 1.0) / np.sqrt(d), _EPS / 4)
    for _ in range(40):
        least = min(least, 1.0)
        s2 = least * least
        dd = np.cbrt(4 * (1 - s2) / (s2 * s2))
        a_ = np.sqrt(1 + dd) + np.sqrt(8 - 4 * dd + 8 * (2 - s2) / (s2 * np.sqrt(1 + dd))) / 2
        b_ = (a_ - 1) ** 2 / 4
        c_ = a_ + b_ - 1
        if c_ > 100:
            q, _r = np.linalg.qr(np.vstack([np.sqrt(c_) * x, eye]))
            new = b_ / c_ * x + (a_ - b_ / c_) / np.sqrt(c_) * (q[:d] @ q[d:].T)
        else:
            low = np.linalg.cholesky(eye + c_ * (x.T @ x))
            half = np.linalg.solve(low, x.T)
            new = b_ / c_ * x + (a_ - b_ / c_) * np.linalg.solve(low.T, half).T
        new = (new + new.T) / 2
        least = least * (a_ + b_ * s2) / (1 + c_ * s2)
        moved, x = float(np.linalg.norm(new - x)), new
        if moved <= np.cbrt(_EPS) / 4 and abs(1 - least) < 10 * _EPS:
            break
    return x


def _projector(a: np.ndarray, shift: float) -> tuple[np.ndarray, int] | None:
    """The projector on the eigenvectors of ``a`` above ``shift``, and their number; None if an eigenvalue is so near
    to the shift, or all are on one side of it, that it does not part them."""
    d = len(a)
    try:
        p = (polar(a - shift * np.eye(d)) + np.eye(d)) / 2
    except np.linalg.LinAlgError:
        return None
    k = round(float(np.trace(p)))
    if not 0 < k < d or not np.isfinite(p).all() or float(np.linalg.norm(p @ p - p)) > 1e-13 * d:
        return None
    return p, k


def _bases(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the projector's range and of its complement: one step of subspace iteration from the
    columns that stand out most."""
    rest, chosen = p.copy(), []
    for _ in range(k):  # columns by their distance from the span of those before
        norms = np.einsum("ij,ij->j", rest, rest)
        norms[chosen] = -1
        j = int(norms.argmax())
        chosen.append(j)
        v = rest[:, j] / np.sqrt(norms[j])
        rest -= np.outer(v, v @ rest)
    q = np.linalg.qr(p @ np.linalg.qr(p[:, chosen])[0], mode="complete")[0]
    return q[:, :k], q[:, k:]


def _shifts(a: np.ndarray) -> Iterator[float]:
    """Shifts to try: around the middle of the diagonal first, then a finer and finer net between the bounds of
    the eigenvalues."""
    diagonal = np.sort(np.diag(a))
    middle, spread = float(np.median(diagonal)), float(np.linalg.norm(a - np.median(diagonal) * np.eye(len(a))))
    yield middle
    yield float(diagonal.mean())
    for cells in (2, 3, 7, 19, 67, 259, 1021, 16 * len(a) + 1):
        for i in sorted(range(1, cells), key=lambda i: abs(2 * i - cells)):
            yield middle + spread * (2 * i / cells - 1)


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and the unit eigenvectors as columns."""
    v = (v + v.T) / 2
    size = float(np.linalg.norm(v))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = [(v, np.eye(len(v)))] if len(v) else []
    while waiting:
        a, basis = waiting.pop()
        middle = float(np.trace(a)) / len(a)
        if len(a) == 1 or float(np.linalg.norm(a - middle * np.eye(len(a)))) <= 4 * _EPS * len(v) * size:
            found.append((np.diag(a).copy(), basis))
            continue
        parted = next(filter(None, (_projector(a, s) for s in _shifts(a))), None)
        if parted is None:
            raise ArithmeticError("no shift parts the spectrum")
        for q in _bases(*parted):
            own = q.T @ a @ q
            waiting.append(((own + own.T) / 2, basis @ q))
    if not found:
        return np.zeros(0), np.zeros((0, 0))
    vectors = _refined(v, np.hstack([b for _, b in found]))
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _refined(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Eigenvectors after two steps of first-order correction, made orthogonal again: what the products of many
    bases lost comes back."""
    for _ in range(2):
        r = np.eye(len(v)) - x.T @ x
        s = x.T @ v @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-8 * max(np.abs(values).max(), np.finfo(float).tiny)
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gap))
        x = x + x @ e
        x = x @ (3 * np.eye(len(v)) - x.T @ x) / 2
    return x / np.linalg.norm(x, axis=0)


class Whitening(NamedTuple):
    """What a fit gives: exact count and sums of the distinct vectors, and the components that whiten them."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return vector.isNotNull() & fine


def on_grid(rows: DataFrame, id_column: str, vector_column: str, scale: int = 64, origin: int = 1_000_000) -> DataFrame:
    """id and x, the usable vectors' whole numbers floor(scale * c) + origin."""
    vector = column(vector_column).cast("array<double>")
    whole = F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))) + F.lit(origin))
    return rows.where(_usable(vector)).select(column(id_column).alias("id"), whole.alias("x"))


def _matrix(batch: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _tasks_sums(term: Callable[[np.ndarray], np.ndarray], d: int, size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        if batch.num_rows:
            part = term(_matrix(batch, 0, d))
            low += part & ((1 << _LOW) - 1)
            high += (part >> _LOW) + (low >> _LOW)
            low &= (1 << _LOW) - 1
    yield pa.RecordBatch.from_arrays([pa.array([high.tobytes()]), pa.array([low.tobytes()])], names=["high", "low"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    high = low = None
    for batch in batches:
        for h, l in zip(batch.column(0), batch.column(1), strict=True):
            h, l = np.frombuffer(h.as_buffer(), np.int64), np.frombuffer(l.as_buffer(), np.int64)
            high, low = (h.copy(), l.copy()) if high is None else (high + h, low + l)
            high += low >> _LOW
            low &= (1 << _LOW) - 1
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array([high.tobytes()]), pa.array([low.tobytes()])], names=["high", "low"])


_SUMS = "high binary, low binary"


def _exact_sums(vectors: DataFrame, term: Callable[[np.ndarray], np.ndarray], d: int, size: int, fan: int = 64) -> list[int]:
    """Sums of whole numbers over all vectors: each task adds up its own, and the tasks' results are folded in two
    steps, so neither the driver nor a task gathers more than a square root of them or so."""
    parts = vectors.select("x").mapInArrow(partial(_tasks_sums, term, d, size), _SUMS)
    folded = parts.repartition(fan).mapInArrow(_folded, _SUMS).coalesce(1).mapInArrow(_folded, _SUMS)
    row = folded.first()
    if row is None:
        return [0] * size
    high, low = np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64)
    return [(int(h) << _LOW) + int(l) for h, l in zip(high, low, strict=True)]


def _count_and_sums(x: np.ndarray) -> np.ndarray:
    if len(x) * max(1, int(np.abs(x).max(initial=0))) >= 1 << 62:
        raise OverflowError("entries too large for exact sums")
    return np.concatenate([[len(x)], x.sum(axis=0)])


def _products(centre: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cross products of distances from ``centre``, exact: floating-point products of whole numbers, over as many
    rows as keep every sum under 2**53."""
    far = x - centre
    largest = max(1, int(np.abs(far).max(initial=0)))
    rows = _EXACT // (largest * largest)
    if not rows:
        raise OverflowError("entries too far from their mean for exact products")
    whole = far.astype(np.float64)
    total = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for i in range(0, len(x), rows):
        total += (whole[i : i + rows].T @ whole[i : i + rows]).astype(np.int64)
    return total.ravel()


def _whitened(fit: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S, exact, and the whitened rows."""
    far = fit.n * x - fit.sums if fit.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 else _long_way(fit, x)
    return far, (far.astype(np.float64) / fit.n) @ (fit.vectors / np.sqrt(fit.values))


def _long_way(fit: Whitening, x: np.ndarray) -> np.ndarray:
    return x.astype(object) * fit.n - fit.sums.astype(object)


def _covariance_parts(fit: Whitening, d: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(fit.values)
    sums, products = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        if batch.num_rows:
            w = _whitened(fit, _matrix(batch, 0, d))[1]
            sums += w.sum(axis=0)
            products += w.T @ w
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + k * k, dtype=np.int32)), pa.array(np.concatenate([sums, products.ravel()]))], names=["at", "v"])


def _identity_error(vectors: DataFrame, fit: Whitening, d: int) -> float:
    """How far the covariance of the whitened fit list is from the identity, measured on the vectors themselves."""
    k = len(fit.values)
    parts = vectors.select("x").mapInArrow(partial(_covariance_parts, fit, d), "at int, v double")
    found = np.zeros(k + k * k)
    for r in parts.groupBy("at").agg(F.sum("v").alias("v")).collect():  # k + k * k rows, k <= components
        found[r["at"]] = r["v"]
    mean = found[:k] / fit.n
    return float(np.abs(found[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def fit(grid: DataFrame, components: int = 16) -> tuple[Whitening | None, int]:
    """The whitening of all distinct vectors of ``grid``, None if there is no component; and the vectors' length."""
    spark = grid.sparkSession
    length = grid.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 0
    if not d:
        return None, 0
    vectors, path = materialise(grid.where(F.size("x") == d).select("x").distinct(), "whitening-fit")
    try:
        n, *sums = _exact_sums(vectors, _count_and_sums, d, d + 1)
        centre = [round(s / n) for s in sums]
        products = _exact_sums(vectors, partial(_products, np.array(centre, np.int64)), d, d * d)
        rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
        v = np.array([[(n * products[i * d + j] - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
        values, axes = spectral_components(v)
        used = min(components, int((values > 1e-12 * max(values[0], 0)).sum()))
        if not used:
            return None, d
        found = Whitening(n, np.array(sums, np.int64), values[:used], axes[:, :used], float(np.trace(v)), 0.0)
        return found._replace(identity_error=_identity_error(vectors, found, d)), d
    finally:
        remove(spark, path)


WHITENED = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"


def _apply(own: Whitening, d: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    k = len(own.values)
    explained = own.values / own.trace
    for batch in batches:
        rows = batch.num_rows
        far, w = _whitened(own, _matrix(batch, 1, d)) if rows else (np.zeros((0, d), np.int64), np.zeros((0, k)))
        if far.dtype == object or rows and d * int(np.abs(far).max()) ** 2 >= 1 << 63:
            squares = [sum(int(f) ** 2 for f in r) for r in far]  # pyarrow raises where one is over 64 bits
        else:
            squares = (far * far).sum(axis=1)
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * k)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(m).ravel())) for m in (w, np.broadcast_to(explained, (rows, k)))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(rows, own.n)), pa.array(squares, pa.int64()), *lists, pa.array(np.full(rows, own.identity_error))],
            names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
        )


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = 16) -> DataFrame:
    """Per usable row: its id, n, its exact deviation, its whitened vector, each component's share of the variance, and
    the fit's distance from the identity."""
    grid = on_grid(rows, id_column, vector_column)
    own, d = fit(grid, components)
    kind = grid.schema["id"].dataType.simpleString()
    if own is None:
        return rows.sparkSession.createDataFrame([], f"id {kind}, {WHITENED}").withColumnRenamed("id", id_column)
    whitened = grid.where(F.size("x") == d).mapInArrow(partial(_apply, own, d), f"id {kind}, {WHITENED}")
    return whitened.withColumnRenamed("id", id_column)


def by_component(whitened: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row for each vector and component, components counted from 1."""
    long = whitened.select(
        column(id_column), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    )
    return long.select(
        column(id_column), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error",
    )
