"""Embedding whitening: a covariance in double-double, and eigenvectors by divide and conquer.

Entries become integers x = floor(1024 c) + 100000. Two aggregates give the count and the exact sums; the tasks then
centre each vector on the exact mean, multiply without error (Dekker's product), add in double-double, and send the high
and the low parts, which are merged in two levels of groups, so neither a task nor the driver sees more than a bounded number of
them. The matrix is made tridiagonal by reflections and solved by divide and conquer. Rows pass through Python in
Arrow batches, a block of rows at a time; what the driver holds is a matrix of the dimension, whatever the rows.

Cases: a vector that is null or holds a null or non-finite entry is dropped; shorter vectors are filled up with zeros to
the longest (an empty one is all zeros); an empty table, or one without a vector, gives no rows; repeated rows and ids
each count and each come back; null ids stay null; other columns are ignored, clashing names too. Components without variance
(eigenvalue at most the dimension times the rounding unit of the largest) have `whitened` 0, so `identity_error` is 1
then; fewer than eight dimensions give as many components. `deviation` is null where it doesn't fit a long. Equal
eigenvalues keep the order in which the solver finds them. Scaled entries saturate at 2 to the 52nd.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabulary.llm.common import table

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Rows that are multiplied at a time, and parts that one task merges.
BLOCK, FAN = 512, 128
_SATURATED = float(1 << 52)
_SPLIT = float((1 << 27) + 1)


# --- double-double: pairs of a rounded value and what rounding took away -------------------------------------------


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as a sum of two values of at most 26 bits, whose products are exact."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def dd_add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e += t
    s, e = s + e, e - ((s + e) - s)
    e += f
    high = s + e
    return high, e - (high - s)


def outer_total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum over vectors (double-double) of the products of their entries, for the upper triangle; summed by halves of the rows."""
    n, width = high.shape
    near, rest = halves(high)
    out = np.zeros((2, width, width))
    for i in range(width):
        a, b = high[:, i : i + 1], high[:, i:]
        product = a * b
        error = ((near[:, i : i + 1] * near[:, i:] - product) + near[:, i : i + 1] * rest[:, i:] + rest[:, i : i + 1] * near[:, i:]) + rest[:, i : i + 1] * rest[:, i:]
        error += a * low[:, i:] + low[:, i : i + 1] * b
        m = n
        while m > 1:
            half = m // 2
            total, lost = two_sum(product[:half], product[m - half : m])
            lost += error[:half] + error[m - half : m]
            product[:half], error[:half] = total, lost
            m -= half
        out[0, i, i:], out[1, i, i:] = two_sum(product[0], error[0]) if n else (0.0, 0.0)
    return out[0], out[1]


# --- symmetric eigenvalues ---------------------------------------------------------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal Q with matrix = Q T Q', by Householder's reflections."""
    a = np.array(matrix, dtype=np.float64)
    n = len(a)
    q = np.eye(n)
    for k in range(n - 2):
        column = a[k + 1 :, k].copy()
        size = np.linalg.norm(column)
        if size == 0 or not column[1:].any():
            continue
        column[0] += np.copysign(size, column[0])
        v = column / np.linalg.norm(column)
        a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return a.diagonal().copy(), (a.diagonal(1) + a.diagonal(-1)) / 2, q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z^2 / (d - x) for rising d: the pole that each is measured from, and its distance, by bisection."""
    n, weight = len(d), rho * z * z
    width = np.append(np.diff(d), weight.sum())
    gaps = d[None, :] - d[:, None]  # row: the lower pole of a root
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (weight / (gaps - width[:, None] / 2)).sum(1)
    base = np.arange(n)
    upper = (middle < 0) & (base < n - 1)  # the root lies in the upper half: measure from the pole above
    base = base + upper
    low = np.where(upper, -width / 2, 0.0)
    high = np.where(upper, 0.0, np.where(np.arange(n) < n - 1, width / 2, width))
    gaps = d[None, :] - d[base][:, None]
    for _ in range(1_100):
        mid = (low + high) / 2
        open_ = (mid > low) & (mid < high)
        if not open_.any():
            break
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            value = 1 + (weight / (gaps - mid[:, None])).sum(1)
        low = np.where(open_ & (value < 0), mid, low)
        high = np.where(open_ & ~(value < 0), mid, high)
    near = np.where(np.abs(low) > np.abs(high), low, high)
    return base, np.where(near == 0, np.where(upper, low, high), near)


def _merge(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of q (diag(d) + rho z z') q', rho positive."""
    order = np.argsort(d, kind="stable")
    d, z, q = d[order], z[order], q[:, order].copy()
    least = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * np.abs(z).max(), np.finfo(float).tiny)
    kept: list[int] = []
    for i in range(len(d)):
        if rho * abs(z[i]) <= least:
            continue  # already an eigenvector
        if kept:
            j = kept[-1]
            size = np.hypot(z[i], z[j])
            c, s = z[i] / size, -z[j] / size
            if abs((d[i] - d[j]) * c * s) <= least:  # two equal poles: turn them so that one has no weight
                z[i], z[j] = size, 0.0
                q[:, j], q[:, i] = c * q[:, j] + s * q[:, i], c * q[:, i] - s * q[:, j]
                d[j], d[i] = d[j] * c * c + d[i] * s * s, d[j] * s * s + d[i] * c * c
                kept.pop()
        kept.append(i)
    values, vectors = d.copy(), q
    if kept:
        k = np.array(kept)
        dk, zk = d[k], z[k]
        base, distance = _secular(dk, zk, rho)
        apart = (dk[base][None, :] - dk[:, None]) + distance[None, :]  # root (column) less pole (row)
        # The weights for which these roots are exact (Loewner), so that the vectors come out orthogonal.
        squared, below = np.empty(len(k)), np.arange(len(k) - 1)
        poles = dk[None, :] - dk[:, None]
        for i in range(len(k)):
            others = np.delete(np.arange(len(k)), i)
            squared[i] = apart[i, -1] * np.prod(apart[i, below] / poles[i, others])
        exact = np.copysign(np.sqrt(np.abs(squared / rho)), zk)
        u = exact[:, None] / -apart
        u /= np.linalg.norm(u, axis=0)
        values[k] = dk[base] + distance
        vectors = q.copy()
        vectors[:, k] = q[:, k] @ u
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and vectors of a symmetric tridiagonal matrix: two halves are solved, then joined by a rank-one change."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m = n // 2
    rho = abs(e[m - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(upper, e[: m - 1]), divide_and_conquer(lower, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    both = np.concatenate([d1, d2])
    if rho == 0:
        order = np.argsort(both, kind="stable")
        return both[order], q[:, order]
    return _merge(both, q, np.concatenate([q1[-1], np.copysign(1.0, e[m - 1]) * q2[0]]), rho)


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and the unit vectors (columns) of a symmetric matrix."""
    if not len(matrix):
        return np.zeros(0), np.zeros((0, 0))
    d, e, q = tridiagonal(matrix)
    values, vectors = divide_and_conquer(d, e)
    vectors = q @ vectors
    return values[::-1].copy(), (vectors / np.linalg.norm(vectors, axis=0))[:, ::-1].copy()


# --- on Spark ----------------------------------------------------------------------------------------------------


def vectors_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their integers x, filled up to the width (None: the longest of them)."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    remain = (bad[ends] == bad[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
    width = int(sizes[remain].max(initial=0)) if width is None else width
    out = np.full((len(column), width), SHIFT, np.int64)
    if len(flat):
        with np.errstate(invalid="ignore", over="ignore"):
            scaled = np.floor(np.clip(np.nan_to_num(flat) * SCALE, -_SATURATED, _SATURATED)).astype(np.int64) + SHIFT
        if width and (sizes == width).all():
            out = scaled.reshape(-1, width)
        else:
            row = np.repeat(np.arange(len(column)), sizes)
            place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
            use = remain[row]
            out[row[use], place[use]] = scaled[use]
    return remain, out[remain]


def totals(rows: DataFrame, vector: str) -> tuple[int, list[int]]:
    """Rows that remain and the exact sum of each dimension; tasks send one row a dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, seen = 0, [], []
        for batch in batches:
            _, x = vectors_of(batch.column(0))
            n += len(x)
            total += [0] * (x.shape[1] - len(total))
            high, low = (x >> 26).sum(0).tolist(), (x & ((1 << 26) - 1)).sum(0).tolist()
            for k, (h, b) in enumerate(zip(high, low)):
                total[k] += (h << 26) + b
            seen += [0] * (x.shape[1] - len(seen))
            for k in range(x.shape[1]):
                seen[k] += len(x)
        places = [-1, *range(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([n, *seen], pa.int64()), pa.array([0, *total], pa.decimal128(38, 0))], names=["place", "rows", "total"])

    found = rows.select(vector).mapInArrow(sums, "place int, rows long, total decimal(38,0)").groupBy("place").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    got = {r["place"]: (r["rows"], int(r["total"])) for r in found.collect()}
    n = got.pop(-1, (0, 0))[0]
    return n, [got[k][1] + SHIFT * (n - got[k][0]) for k in range(len(got))]


def gathered(rows: DataFrame, vector: str, start: Callable[[], object], add: Callable, state: Callable, join: Callable) -> list[np.ndarray]:
    """One array of doubles for each task, from all its rows, merged FAN at a time in two levels; a bounded number reaches the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = start()
        for batch in batches:
            held = add(held, batch.column(0))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part // FAN], pa.int64()), pa.array([state(held).tolist()], pa.list_(pa.float64()))], names=["part", "state"])

    def merge(group: pa.Table) -> pa.Table:
        states = [np.asarray(s) for s in group.column("state").to_pylist()]
        held = states[0]
        for other in states[1:]:
            held = join(held, other)
        return pa.table({"part": pa.array([group.column("part")[0].as_py() // FAN], pa.int64()), "state": pa.array([held.tolist()], pa.list_(pa.float64()))})

    shape = "part long, state array<double>"
    merged = rows.select(vector).mapInArrow(own, shape).groupBy("part").applyInArrow(merge, shape).groupBy("part").applyInArrow(merge, shape)
    return [np.asarray(r["state"]) for r in merged.collect()]


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # falling
    vectors: np.ndarray  # columns
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """The exact means as double-double."""
        high = np.array([s / self.n for s in self.sums])
        return high, np.array([float(Fraction(s, self.n) - Fraction(float(h))) for s, h in zip(self.sums, high)])

    def project(self, x: np.ndarray, most: int) -> np.ndarray:
        high, low = self.means()
        near, rest = two_sum(x.astype(np.float64), -high)
        values, flat = self.values[:most], self.values[:most] <= self.width * np.finfo(float).eps * max(self.values[:1].max(initial=0), 0)
        out = (near + (rest - low)) @ self.vectors[:, :most] / np.sqrt(np.where(flat, 1, values))
        out[:, flat] = 0.0
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2 as whole numbers."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most < 1 << 62 and x.size:
            gap = x * self.n - np.array(self.sums, np.int64)
            if int(np.abs(gap).max()) ** 2 * self.width < 1 << 63:
                return (gap * gap).sum(1).tolist()
        out = [sum((v * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def covariance(rows: DataFrame, vector: str, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of x with divisor n, rounded from double-double."""
    width = len(sums)
    high, low = Whitening(n, sums, np.zeros(0), np.zeros(0), 0).means()

    def add(held: np.ndarray, column: pa.Array) -> np.ndarray:
        _, x = vectors_of(column, width)
        for at in range(0, len(x), BLOCK):
            near, rest = two_sum(x[at : at + BLOCK].astype(np.float64), -high)
            held = np.stack(dd_add(held, outer_total(*two_sum(near, rest - low))))
        return held

    join = lambda a, b: np.concatenate(dd_add(np.split(a, 2), np.split(b, 2)))
    states = gathered(rows, vector, lambda: np.zeros((2, width, width)), add, np.ravel, join)
    total = states[0]
    for other in states[1:]:
        total = join(total, other)
    upper = np.triu((total[: width * width] / n + total[width * width :] / n).reshape(width, width))
    return upper + np.triu(upper, 1).T


def fit(rows: DataFrame, vector: str = "embedding") -> Whitening | None:
    """Learns from all vectors that remain; None without any."""
    n, sums = totals(rows, vector)
    if not n:
        return None
    matrix = covariance(rows, vector, n, sums) if sums else np.zeros((0, 0))
    return Whitening(n, sums, *eigen(matrix), float(matrix.trace()))


def identity_error(rows: DataFrame, own: Whitening, vector: str = "embedding", most: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the whitened values less the identity; parts are centred on their own means and merged by Chan's rule."""
    k = min(most, own.width)

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1 : k + 1] - a[1 : k + 1]
        return np.concatenate([[n], a[1 : k + 1] + gap * b[0] / n, a[k + 1 :] + b[k + 1 :] + np.outer(gap, gap).ravel() * (a[0] * b[0] / n)])

    def add(held: np.ndarray, column: pa.Array) -> np.ndarray:
        y = own.project(vectors_of(column, own.width)[1], k)
        if not len(y):
            return held
        mean = y.mean(0)
        return join(held, np.concatenate([[len(y)], mean, ((y - mean).T @ (y - mean)).ravel()]))

    if not k:
        return 0.0
    states = gathered(rows, vector, lambda: np.zeros(1 + k + k * k), add, np.asarray, join)
    total = states[0]
    for other in states[1:]:
        total = join(total, other)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def whitened(rows: DataFrame, own: Whitening, error: float, ident: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector that remains and each component."""
    k = min(most, own.width)
    explained = [float(v / own.trace) if own.trace > 0 else 0.0 for v in own.values[:k]]
    kind = rows.schema[ident].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            remain, x = vectors_of(batch.column(1), own.width)
            ids = batch.column(0).filter(pa.array(remain))
            many = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                    pa.array(np.full(many * k, own.n), pa.int64()),
                    pa.array(own.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(many), k))),
                    pa.array(own.project(x, k).ravel(), pa.float64()),
                    pa.array(np.tile(explained, many), pa.float64()),
                    pa.array(np.full(many * k, error), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    shape = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.select(ident, vector).mapInArrow(spread, shape)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of all embeddings in the eight leading components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    own = fit(rows)
    if own is None:
        return whitened(rows, Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0), 0.0)
    return whitened(rows, own, identity_error(rows, own))
