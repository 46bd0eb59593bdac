"""PCA whitening of an embedding table by incremental eigendecomposition.

Entries are fixed-point integers, ``x = floor(1024 * c) + 100000``, so counts and sums are exact. Every task holds a
*spectrum*: count, mean, and the eigenvalues and eigenvectors of its scatter matrix. A row moves it by one centred
rank-one update: with ``z`` the row less the mean in the basis of the eigenvectors, the new eigenvalues are the roots of
the secular equation ``1 + rho * sum(z_j^2 / (d_j - t)) = 0``. Entries of ``z`` that are next to nothing, and all but one
of those that belong to equal eigenvalues, are deflated; the eigenvectors come from a ``z`` recomputed from the roots, by
which they stay orthogonal however close the roots are. Rows come in blocks: a block of more rows than dimensions is
reduced (QR of the centred block) to as many rows as dimensions with the same scatter, which are then applied one by one,
followed by one update for the distance of the two means; this keeps the cost of a row at a few microseconds.

Spectra of tasks are combined in a tree: the eigenpairs of one are rank-one updates of the other. The last one is refined
by Rayleigh-Ritz: its basis is made orthonormal, all rows (centred by the exact mean) are projected onto it, the small
matrix of the projections is solved, and the basis is turned by the solution; ``ROUNDS`` times. What reaches the
driver is one matrix of d by d numbers.

Defined cases: vectors that are null, empty or hold a null or non-finite entry are dropped, and so are vectors whose
size is not the most frequent one (the largest among equals); rows without an id are kept like others; repeated rows
count as often as they stand there; a component without variance has ``whitened`` 0 and ``explained`` 0; an empty table
gives no rows; other columns, whatever their names, are dropped. If a sum of a dimension passes 64 bits the job fails with
an overflow, as it would not be exact.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .trees import reduced

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
BLOCK = 1 << 14  # rows
ROUNDS = 2
EPS = np.finfo(np.float64).eps


# ------------------------------------------------------------------------------ rank-one updates


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of ``1 + rho * sum(z^2 / (d - t))`` for rising, distinct ``d``, ``rho > 0`` and ``z`` without zeros.

    A root is returned as the pole that it is nearest to and its distance from it, which is accurate to the last digits.
    All roots are found at once: rational steps through both neighbouring poles, kept within a bracket by bisection."""
    n, w = len(d), rho * z * z
    gap = np.append(np.diff(d), w.sum() * (1 + 1e-6))  # the last root is at most w.sum() from its pole
    upper = np.append(d[1:], d[-1] + gap[-1])
    mid = d + gap / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1 + (w[None, :] / (d[None, :] - mid[:, None])).sum(1) >= 0
    left[-1] = True
    pole = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    origin = d[pole]
    lo, hi = np.where(left, 0.0, -gap / 2), np.where(left, np.where(np.arange(n) == n - 1, gap, gap / 2), 0.0)
    y = (lo + hi) / 2
    base = d[None, :] - origin[:, None]
    below = np.tril(np.ones((n, n), bool))
    near, far = d - origin, upper - origin
    todo = np.arange(n)
    for _ in range(100):
        t = y[todo]
        delta = base[todo] - t[:, None]
        parts = w / delta
        f = 1 + parts.sum(1)
        lo[todo], hi[todo] = np.where(f < 0, t, lo[todo]), np.where(f < 0, hi[todo], t)
        done = (np.abs(f) <= 4 * EPS * n * (1 + np.abs(parts).sum(1))) | (hi[todo] - lo[todo] <= 2 * EPS * np.minimum(np.abs(lo[todo]), np.abs(hi[todo])))
        slope = parts / delta
        psi = np.where(below[todo], slope, 0).sum(1)
        phi = slope.sum(1) - psi
        a, b = near[todo] - t, far[todo] - t
        c = f - a * psi - b * phi
        p, q = (a + b) * f - a * b * (psi + phi), a * b * f
        with np.errstate(divide="ignore", invalid="ignore"):
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            new = t + step
        ok = np.isfinite(new) & (new > lo[todo]) & (new < hi[todo])
        y[todo] = np.where(done, t, np.where(ok, new, (lo[todo] + hi[todo]) / 2))
        todo = todo[~done]
        if not len(todo):
            break
    return pole, y


def rank_one(d: np.ndarray, u: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``u diag(d) u^T + rho v v^T``, ``rho >= 0``."""
    z = u.T @ v
    size = np.linalg.norm(z)
    if rho <= 0 or size == 0:
        return d, u
    tol = 8 * EPS * max(d[-1], rho * size * size)
    small = rho * np.abs(z) * size <= tol
    # of equal eigenvalues, a reflection leaves one entry of z
    close = np.append(np.diff(d) <= tol, False)
    if (close & ~small).any():
        z, u = z.copy(), u.copy()
        edges = np.flatnonzero(~close) + 1
        begin = 0
        for end in edges:
            part = z[begin:end]
            if end - begin > 1 and (np.abs(part[:-1]) > 0).any():
                h = part.copy()
                signed = np.copysign(np.linalg.norm(part), part[-1])
                h[-1] += signed
                u[:, begin:end] -= np.outer(u[:, begin:end] @ h, 2 * h / (h @ h))
                z[begin:end] = 0
                z[end - 1] = -signed
            begin = end
        small = rho * np.abs(z) * size <= tol
    live = np.flatnonzero(~small)
    if not len(live):
        return d, u
    dl, zl = d[live], z[live]
    pole, y = secular_roots(dl, zl, rho)
    gaps = (dl[pole][None, :] - dl[:, None]) + y[None, :]  # of root i from pole j, at [j, i]
    # the z of which these roots are exact, so that the eigenvectors are orthogonal
    apart = dl[None, :] - dl[:, None]
    np.fill_diagonal(apart, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        k = len(live)
        i, j = np.indices((k, k))
        # roots below the pole meet the pole of the same number, those above the next one
        shifted = np.where(i < j, apart.T, np.where(i < k - 1, np.roll(apart.T, -1, axis=0), 1.0))
        ratio = np.where(i < k - 1, gaps.T / np.where(shifted == 0, 1.0, shifted), gaps.T)
        sq = np.abs(np.prod(ratio, axis=0))
    exact = np.sqrt(sq / rho) * np.sign(zl)
    if not np.isfinite(exact).all():
        exact = zl
    vec = -exact[:, None] / gaps
    vec /= np.linalg.norm(vec, axis=0)
    d, out = d.copy(), u.copy()
    d[live] = np.maximum(dl[pole] + y, 0)
    out[:, live] = u[:, live] @ vec
    order = np.argsort(d, kind="stable")
    return d[order], out[:, order]


class Spectrum:
    """Count, mean and eigenpairs of the scatter matrix of the rows seen."""

    def __init__(self, dim: int) -> None:
        self.n, self.mean, self.d, self.u = 0, np.zeros(dim), np.zeros(dim), np.eye(dim)

    def add(self, rows: np.ndarray) -> None:
        """Centred rank-one updates by a block of rows."""
        n = len(rows)
        if n <= len(self.mean):
            for row in rows:
                self._moved(1, row)
            return
        mean = rows.mean(0)
        for row in np.linalg.qr(rows - mean, mode="r"):
            self.d, self.u = rank_one(self.d, self.u, row, 1.0)
        self._moved(n, mean)

    def merge(self, other: Spectrum) -> None:
        """The eigenpairs of the other one as rank-one updates, then the distance of the means."""
        for value, vec in zip(other.d, other.u.T, strict=True):
            self.d, self.u = rank_one(self.d, self.u, vec, value)
        self._moved(other.n, other.mean)

    def _moved(self, n: int, mean: np.ndarray) -> None:
        if n:
            away = mean - self.mean
            self.d, self.u = rank_one(self.d, self.u, away, self.n * n / (self.n + n))
            self.n += n
            self.mean = self.mean + away * (n / self.n)

    def dump(self) -> bytes:
        return packed(np.array([self.n], np.float64), self.mean, self.d, self.u)

    @staticmethod
    def load(data: bytes) -> Spectrum:
        n, mean, d, u = unpacked(data)
        out = Spectrum(len(mean))
        out.n, out.mean, out.d, out.u = int(n[0]), mean, d, u
        return out


def packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def unpacked(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return [z[f"arr_{k}"] for k in range(len(z.files))]


# ------------------------------------------------------------------------------ Spark jobs


def fixed_point(vectors: DataFrame, vec: str) -> DataFrame:
    """``vectors`` with ``x``, the exact integers, less the rows that are dropped."""
    v = F.col(vec)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.filter(sound)
    sizes = kept.groupBy(F.size(v).alias("size")).agg(F.count(F.lit(1)).alias("c"))
    usual = sizes.agg(F.max(F.struct("c", "size")).alias("m")).select(F.col("m.size").alias("usual"))
    row = usual.first()  # one number
    if row["usual"] is None:
        return kept.limit(0).withColumn("x", F.lit(None).cast("array<bigint>"))
    return kept.filter(F.size(v) == row["usual"]).withColumn("x", F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """Rows of ``x``, ``BLOCK`` at a time."""
    held, n = [], 0
    for batch in batches:
        x = _matrix(batch.column("x"), dim)
        for at in range(0, len(x), BLOCK):
            held.append(x[at : at + BLOCK])
            n += len(held[-1])
            if n >= BLOCK:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _one(state: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([state], pa.binary())], names=["at", "state"])


def spectrum(points: DataFrame, dim: int) -> Spectrum | None:
    """The combined spectrum of all rows of ``x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(dim)
        for rows in _blocks(batches, dim):
            own.add(rows - float(SHIFT))
        if own.n:
            yield _one(own.dump())

    def merge(states: list[bytes]) -> bytes:
        out = Spectrum.load(states[0])
        for s in states[1:]:
            out.merge(Spectrum.load(s))
        return out.dump()

    data = reduced(points.select("x").mapInArrow(run, "at int, state binary"), merge, "spectra")
    return Spectrum.load(data) if data else None


def projected_scatter(points: DataFrame, dim: int, total: list[int], n: int, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the rows' projections on the columns of ``basis``, each row centred exactly beforehand."""
    sums = np.array(total, np.int64)
    whole, rest = np.divmod(sums, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, m2 = 0, np.zeros(basis.shape[1]), np.zeros((basis.shape[1],) * 2)
        for rows in _blocks(batches, dim):
            count, mean, m2 = _joined((count, mean, m2), _moments(((rows - whole) - rest / n) @ basis))
        if count:
            yield _one(packed(np.array([count], np.float64), mean, m2))

    def merge(states: list[bytes]) -> bytes:
        out = (0, 0.0, 0.0)
        for s in states:
            c, mean, m2 = unpacked(s)
            out = _joined(out, (int(c[0]), mean, m2))
        return packed(np.array([out[0]], np.float64), out[1], out[2])

    _, mean, m2 = unpacked(reduced(points.select("x").mapInArrow(run, "at int, state binary"), merge, "projections"))
    return mean, m2 / n


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(0)
    return len(w), mean, (w - mean).T @ (w - mean)


def _joined(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    away = b[1] - a[1]
    return n, a[1] + away * (b[0] / n), a[2] + b[2] + np.outer(away, away) * (a[0] * b[0] / n)


def exact_sums(points: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the sum of each dimension; combined in the tasks before the shuffle."""
    sums = points.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c")).orderBy("at").collect()  # a row for each dimension
    return (sums[0]["c"], [r["s"] for r in sums]) if sums else (0, [])


def fit(points: DataFrame) -> dict | None:
    """Count, sums, components (columns, by falling eigenvalue), eigenvalues and trace of the covariance of ``x``."""
    n, total = exact_sums(points)
    if not n:
        return None
    dim = len(total)
    basis = np.linalg.qr(spectrum(points, dim).u[:, ::-1])[0]
    for _ in range(ROUNDS):
        _, ritz = projected_scatter(points, dim, total, n, basis)
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        basis = np.linalg.qr(basis @ turn[:, ::-1])[0]
        values = values[::-1]
    # one sign for all: the largest entry is positive
    basis = basis * np.where(basis[np.abs(basis).argmax(0), np.arange(dim)] < 0, -1.0, 1.0)
    return {"n": n, "sums": total, "basis": basis, "values": np.maximum(values, 0), "trace": float(max(np.trace(ritz), 0))}


def whiten(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every vector and component.

    ``deviation`` is decimal(38,0): the exact sum of ``(n * x - S)^2`` over the dimensions."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    points = saved(fixed_point(vectors.select(F.col(key).alias("key"), F.col(vec).alias("v")), "v").select("key", "x"), "fixed-point")
    model = fit(points)
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    n, total, dim = model["n"], model["sums"], len(model["sums"])
    k = min(components, dim)
    values = model["values"][:k]
    real = values > 64 * EPS * max(model["trace"], 1.0)
    matrix = model["basis"][:, :k] * np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
    explained = np.where(real, values, 0.0) / (model["trace"] or 1.0)
    _, cov = projected_scatter(points, dim, total, n, matrix)
    error = float(np.abs(cov - np.diag(real.astype(float))).max())
    sums = np.array(total, np.int64)
    whole, rest = np.divmod(sums, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _matrix(part.column("x"), dim)
                m = len(x)
                w = ((x - whole) - rest / n) @ matrix
                away = float(np.abs(x - whole).max()) + 1
                if (away * n) ** 2 * dim < 2.0**62:
                    dev = pa.array((((x - whole) * n - rest) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
                else:  # beyond 64 bits
                    big = (x - whole).astype(object) * n - rest.astype(object)
                    dev = pa.array([Decimal(int(v)) for v in (big * big).sum(1)], pa.decimal128(38, 0))
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                     dev.take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return points.mapInArrow(run, schema).withColumnRenamed("key", key)
