"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become integers ``x = floor(64 * c) + 1000000``, so sums and products
are exact and the result does not depend on how rows are dealt to tasks.

1. The fit list holds each distinct x vector once (a grouping on the packed
   vector; a vector that a third of the rows repeat is merged before the
   shuffle). It is written, since it is read three times.
2. Sums, then products of vectors centred at the rounded mean: each task sends
   one row per pair of dimensions, Spark adds them, and ``d * d`` numbers reach
   the driver. The fraction lost by rounding the mean is put back exactly in
   integers, so the scatter is that of exactly centred vectors.
3. Pivoted Cholesky factors the scatter, ``P' A P = L L'``. One-sided Jacobi
   rotates the columns of ``L`` until they are orthogonal, without forming a
   product again; the squared column norms are then the eigenvalues of the
   scatter and the normalised columns its eigenvectors.
4. One pass over the fit list measures the covariance of the whitened vectors
   against the identity, one pass over the rows gives the result.

Rows take no part if the vector is null or empty, has a null or non-finite
entry, an entry of ``2 ** 44`` or more (its ``x`` would not be exact) or another
length than most vectors (of two lengths as frequent, the longer one counts).
Components of eigenvalue 0 (up to rounding) are not returned: constant or
dependent dimensions, fewer rows than dimensions, a single distinct vector and
an empty table give fewer components or no rows. Eigenvectors of equal
eigenvalues are one of the possible choices. Null ids are carried along, rows
that share an id are rows of their own, extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from distkpi.llm.common import materialize

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = float(1 << 44)
_EXACT = 1 << 53            # sums of products below this are exact in doubles
_LONG = 1 << 62


# ---- linear algebra on the driver: d x d ----------------------------------------

def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(l, order)`` with ``a[order][:, order] = l @ l.T``; ``l`` has one column per dimension of the rank."""
    a = a.copy()
    d = len(a)
    order, l = np.arange(d), np.zeros((d, d))
    limit = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= limit:
            return l[:, :k], order
        for m in (a, a.T, l):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        l[k, k] = np.sqrt(a[k, k])
        l[k + 1:, k] = a[k + 1:, k] / l[k, k]
        a[k + 1:, k + 1:] -= np.outer(l[k + 1:, k], l[k + 1:, k])
    return l, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of ``n`` columns once, in rounds of disjoint pairs."""
    ring, out = list(range(n + n % 2)), []
    for _ in range(len(ring) - 1):
        pairs = [(i, j) for i, j in zip(ring[:len(ring) // 2], reversed(ring[len(ring) // 2:])) if max(i, j) < n]
        out.append((np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def orthogonal_columns(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``l`` times rotations, with orthogonal columns."""
    g = l.copy()
    tolerance = max(g.shape) * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for i, j in _rounds(g.shape[1]):
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > tolerance
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = cos * x - cos * t * y, cos * t * x + cos * y
        if worst <= tolerance:
            return g
    raise ArithmeticError(f"columns still {worst} from orthogonal after {sweeps} sweeps")


class Whitening(NamedTuple):
    """A fitted whitening."""

    n: int
    sums: list[int]              # per dimension, exact
    values: np.ndarray           # eigenvalues of the covariance, falling
    vectors: np.ndarray          # unit eigenvectors, one column each
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` as doubles: the rounded mean leaves exactly, then its fraction."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.int64)).astype(float) - np.array(rest, float) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of ``(n * x - sums) ** 2`` of each row, exact; none if beyond a 64-bit integer."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        d = x - np.array(whole, np.int64)
        most = self.n * (int(np.abs(d).max(initial=0)) + 1)
        if most * most * x.shape[1] < _LONG:
            return ((self.n * d - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * d.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def decompose(n: int, sums: list[int], whole: list[int], products: dict[tuple[int, int], int],
              components: int = COMPONENTS) -> Whitening:
    """The whitening from exact sums, and exact products of the vectors less ``whole``."""
    d = len(sums)
    rest = [s - n * w for s, w in zip(sums, whole)]
    a = np.zeros((d, d))
    for (i, j), p in products.items():
        a[i, j] = a[j, i] = float(Fraction(n * p - rest[i] * rest[j], n * n))
    trace = float(sum(Fraction(n * products[i, i] - rest[i] ** 2, n * n) for i in range(d)))
    l, order = pivoted_cholesky(a)
    g = orthogonal_columns(l)
    norms = np.sqrt((g * g).sum(0))
    by = np.argsort(-norms, kind="stable")[:components]
    vectors = np.zeros((d, len(by)))
    vectors[order] = g[:, by] / norms[by]
    return Whitening(n, sums, norms[by] ** 2, vectors, trace)


# ---- rows -----------------------------------------------------------------------

def usable(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(LARGEST)))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def integers(vectors: DataFrame, column: str = "embedding", id: str = "vec_id") -> DataFrame:
    """vec_id, x: the rows that take part, entries as integers."""
    v = F.col(f"`{column}`").cast("array<double>")
    x = F.transform("_v", lambda c: F.floor(c * SCALE) + SHIFT)
    rows = vectors.select(F.col(f"`{id}`").alias("vec_id"), v.alias("_v")).filter(usable(F.col("_v"))).select(
        "vec_id", x.alias("x"))
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "d"))["d"]).first()[0]       # one number
    return rows.filter(F.size("x") == F.lit(usual or 0))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), np.int64)


def _added(fit: DataFrame, partial, exact: bool = True) -> dict:
    """Sums over the fit list of what ``partial`` gives for a block of vectors, as ``{key: value}``.

    A task sends one row per key; the keys are pairs of dimensions.
    """
    kind = "decimal(38,0)" if exact else "double"

    def run(batches):
        total: dict = {}
        for batch in batches:
            for key, value in partial(_matrix(batch, "x")):
                total[key] = total.get(key, 0) + value
        if total:
            keys = list(total)
            values = [Decimal(int(total[k])) if exact else float(total[k]) for k in keys]
            for at in range(0, len(keys), 10_000):
                part = keys[at:at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in part], pa.int32()), pa.array([k[1] for k in part], pa.int32()),
                     pa.array(values[at:at + 10_000], pa.decimal128(38, 0) if exact else pa.float64())],
                    names=["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, f"i int, j int, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v"))
    return {(r["i"], r["j"]): int(r["v"]) if exact else r["v"] for r in rows.collect()}


def _sums(x: np.ndarray):
    big = len(x) * int(np.abs(x).max(initial=0)) >= _LONG
    total = (x.astype(object) if big else x).sum(axis=0)
    yield (-1, -1), len(x)
    yield from (((i, i), v) for i, v in enumerate(total.tolist()))


def _products(x: np.ndarray, whole: list[int]):
    d = x - np.array(whole, np.int64)
    most = int(np.abs(d).max(initial=0))
    rows = max(1, min(len(d), _EXACT // max(1, most * most)))
    if most * most < _EXACT:
        total = sum((np.rint(b.T @ b).astype(np.int64).astype(object)
                     for b in (d[k:k + rows].astype(float) for k in range(0, len(d), rows))), start=0)
    else:
        total = d.T.astype(object) @ d.astype(object)
    yield from (((i, j), total[i, j]) for i in range(d.shape[1]) for j in range(i + 1))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of the distinct vectors of :func:`integers`, and the fit list (none: no rows)."""
    listed = materialize(rows.select("x").distinct(), "whitening-fit")
    sums = _added(listed, _sums)
    if not sums:
        return None, listed
    n, d = sums.pop((-1, -1)), len(sums)
    total = [sums[i, i] for i in range(d)]
    whole = [s // n for s in total]
    products = _added(listed, lambda x: _products(x, whole))
    return decompose(n, total, whole, products, components), listed


def identity_error(w: Whitening, listed: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance less the identity (divisor ``n``, centred)."""
    k = len(w.values)
    sums = _added(listed, lambda x: (((i, i), v) for i, v in enumerate(w.whiten(x).sum(axis=0))), exact=False)
    mean = np.array([sums[i, i] / w.n for i in range(k)])

    def products(x: np.ndarray):
        y = w.whiten(x) - mean
        p = y.T @ y
        return (((i, j), p[i, j]) for i in range(k) for j in range(i + 1))

    found = _added(listed, products, exact=False)
    return max((abs(v / w.n - (i == j)) for (i, j), v in found.items()), default=0.0)


def whiten(vectors: DataFrame, column: str = "embedding", id: str = "vec_id",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per row and component."""
    rows = integers(vectors, column, id)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, "
              "explained double, identity_error double")
    w, listed = fit(rows, components)
    if w is None or not len(w.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(w, listed), len(w.values)

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch, "x")
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array([w.n] * (m * k), pa.int64()), pa.array(w.deviation(x), pa.int64()).take(pa.array(each)),
                 pa.array(w.whiten(x).ravel()), pa.array(np.tile(w.values / w.trace, m)),
                 pa.array([error] * (m * k), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
