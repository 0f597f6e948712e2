"""Operator 13: whitening by a block Jacobi-Davidson iteration on distributed centred products.

Entries become integers (``floor(SCALE * c) + SHIFT``), so sums are exact in any order. The fit
list, each distinct vector once, is written as blocks of rows; the covariance matrix is never
formed. One pass over the blocks multiplies it with a block of vectors, rows centred first. The
largest eigenpairs come from Rayleigh-Ritz on a growing subspace; each outer step solves the
projected correction equations of all open pairs side by side with a few steps of MINRES, so a
step costs one pass however many pairs are open. Pairs whose residual reaches double precision are
locked. Only matrices of dimension x components reach the driver.

Vectors that are null or empty or hold null or non-finite entries are dropped, and those whose
length is not the most frequent one (the larger of equals). Entries beyond ``LARGEST`` count as
that. Directions without variance cannot be scaled to one and are left out, so a fit list of one
vector, and an empty table, give no rows. Null and repeated keys are rows like any others; repeated
vectors get equal values. ``deviation`` is null where it exceeds a long. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.llm.files import scan_partitions
from monthloom.shipping import ship_package
from monthloom.staging import stage

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 44)
COMPONENTS = 16
INNER = 5  # MINRES steps of a correction equation
_BLOCK_ROWS, _BLOCK_VALUES = 4096, 1 << 19
_FAN_IN = 64  # partial results that are added at a time
_EPS = np.finfo(float).eps


# --- the solver, on any symmetric product --------------------------------------------------------

def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``block``'s part outside the given spaces."""
    for _ in range(2):
        for q in against:
            block = block - q @ (q.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-8 * strength[0]]
    return block


def minres(product: Callable[[np.ndarray], np.ndarray], rhs: np.ndarray, steps: int) -> np.ndarray:
    """Solutions of symmetric systems, one per column, after ``steps`` joint products."""
    width = rhs.shape[1]
    x, v_old = np.zeros_like(rhs), np.zeros_like(rhs)
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v = rhs / np.where(live, beta, 1)
    eta, beta = beta.copy(), np.zeros(width)
    c = c_old = np.ones(width)
    s = s_old = np.zeros(width)
    for _ in range(steps):
        if not live.any():
            break
        z = product(v) - v_old * beta
        alpha = (v * z).sum(axis=0)
        z -= v * alpha
        after = np.linalg.norm(z, axis=0)
        diagonal = c * alpha - c_old * s * beta
        upper, far = s * alpha + c_old * c * beta, s_old * beta
        pivot = np.hypot(diagonal, after)
        live = live & (pivot > 0)
        safe = np.where(live, pivot, 1)
        c_old, s_old, c, s = c, s, diagonal / safe, after / safe
        w, w_old = (v - w * upper - w_old * far) / safe, w
        x = np.where(live, x + w * (c * eta), x)
        eta = -s * eta
        live = live & (after > _EPS * pivot)
        v_old, v = v, z / np.where(after > 0, after, 1)
        beta = after
    return x


def largest_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int,
                  inner: int = INNER, seed: int = 13, most: int = 300
                  ) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite product, falling, and unit
    eigenvectors as columns. Residuals reach 32 roundings of the largest eigenvalue, or the level
    at which rounding stops them."""
    wanted = min(wanted, dim)
    if not wanted:
        return np.zeros(0), np.zeros((dim, 0))
    widest = min(dim, max(4 * wanted, wanted + 24))
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = _orthonormal(rng.normal(size=(dim, min(dim, 2 * wanted))))
    image = product(basis)
    best, idle = np.inf, 0
    for _ in range(most):
        need = wanted - len(values)
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn[:, :need], image @ turn[:, :need]
        off = moved - ritz * theta[:need]
        off -= locked @ (locked.T @ off)
        size = np.linalg.norm(off, axis=0)
        top = max(theta[0], values.max(initial=0.0), np.finfo(float).tiny)
        limit = 32 * _EPS * top
        whole = basis.shape[1] + locked.shape[1] >= dim
        idle = idle + 1 if size.max() > best / 2 else 0
        best = min(best, size.max())
        stuck = idle >= 4 and best <= 1e4 * limit  # rounding allows no more
        done = int(np.argmin(np.append(size <= limit, False)))  # only from the largest on
        done = need if whole or stuck else done
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            values = np.append(values, theta[:done])
            basis, image = basis @ turn[:, done:], image @ turn[:, done:]
            ritz, off, theta = ritz[:, done:], off[:, done:], theta[done:]
            best, idle = np.inf, 0
            if len(values) == wanted:
                break
            need -= done
        else:
            basis, image = basis @ turn, image @ turn
        if basis.shape[1] + need > widest:
            keep = min(basis.shape[1], need + 8)
            basis, image = basis[:, :keep], image[:, :keep]
        space = np.column_stack([locked, ritz])

        def shifted(block: np.ndarray) -> np.ndarray:
            block = block - space @ (space.T @ block)
            out = product(block) - block * theta[:need]
            return out - space @ (space.T @ out)

        step = minres(shifted, -(off - space @ (space.T @ off)), inner)
        fresh = _orthonormal(step, locked, basis)
        if not fresh.shape[1]:
            fresh = _orthonormal(rng.normal(size=(dim, need)), locked, basis)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    else:
        raise RuntimeError(f"{wanted - len(values)} of {wanted} eigenpairs did not converge.")
    # One Rayleigh-Ritz step on fresh products of the locked vectors.
    locked = _orthonormal(locked)
    small = locked.T @ product(locked)
    theta, turn = np.linalg.eigh((small + small.T) / 2)
    locked = locked @ turn[:, ::-1]
    sign = np.sign(locked[np.abs(locked).argmax(axis=0), np.arange(locked.shape[1])])
    return theta[::-1], locked * sign


# --- passes over the fit list --------------------------------------------------------------------

def finite_vector(vector: str) -> Column:
    """True for a vector that is not null or empty and has neither null nor non-finite entries."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vector: str) -> Column:
    def entry(v: Column) -> Column:
        held = F.greatest(F.least(v.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.floor(F.lit(float(SCALE)) * held) + F.lit(SHIFT).cast("long")

    return F.transform(vector, entry)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, dim)


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """The rows' vectors packed end to end; each block is bounded in rows and in bytes."""
    most = max(1, min(_BLOCK_ROWS, _BLOCK_VALUES // dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), most):
                data = np.ascontiguousarray(x[at: at + most]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["data"])

    return rows.mapInArrow(pack, "data binary")


@dataclass
class FitList:
    """Distinct integer vectors as blocks, with their number and exact sums."""

    blocks: DataFrame
    dim: int
    parts: int
    n: int = 0
    base: np.ndarray | None = None  # whole part of the mean
    rest: np.ndarray | None = None  # sums less ``n`` times that

    def _sum(self, work: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
        """Sum of ``work``'s arrays over all blocks, in an order that the data fix."""
        dim = self.dim

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(length), b""
            for batch in batches:
                for data in batch.column(0):
                    raw = data.as_buffer()
                    seen = seen or raw.to_pybytes()[:64]
                    total += work(np.frombuffer(raw, np.int64).reshape(-1, dim))
            if seen:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([seen]), pa.array([total.tobytes()])], names=["first", "data"])

        partial = self.blocks.mapInArrow(add, "first binary, data binary")
        if self.parts > _FAN_IN:
            partial = partial.withColumn("at", F.pmod(F.xxhash64("first"), F.lit(
                -(-self.parts // _FAN_IN)))).groupBy("at").applyInPandas(
                _added, "first binary, data binary")
        return _added(partial.toPandas(), length)

    def measure(self) -> None:
        dim = self.dim

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, dim)
                    # Halves, so that no sum over partitions leaves the range of a long.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(dim)), pa.array(np.full(dim, len(x))),
                         pa.array((x >> 20).sum(axis=0)), pa.array((x & 0xFFFFF).sum(axis=0))],
                        names=["at", "n", "high", "low"])

        rows = self.blocks.mapInArrow(sums, "at long, n long, high long, low long").groupBy(
            "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"),
                      F.sum("low").alias("low")).orderBy("at").collect()
        self.n = rows[0]["n"] if rows else 0
        total = [(r["high"] << 20) + r["low"] for r in rows]
        self.base = np.array([t // self.n for t in total], np.int64)
        self.rest = np.array([t % self.n for t in total], np.int64)

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        base, part = self.base, self.rest / self.n
        return lambda x: (x - base) - part

    def trace(self) -> float:
        centre = self.centre()
        return float(self._sum(lambda x: np.array([np.square(centre(x)).sum()]), 1)[0]) / self.n

    def product(self, block: np.ndarray) -> np.ndarray:
        """Covariance times ``block``, by one pass."""
        centre, shape = self.centre(), block.shape

        def work(x: np.ndarray) -> np.ndarray:
            c = centre(x)
            return (c.T @ (c @ block)).ravel()

        return self._sum(work, block.size).reshape(shape) / self.n

    def identity_error(self, projection: np.ndarray) -> float:
        """Largest absolute entry of the whitened covariance minus the identity."""
        centre, k = self.centre(), projection.shape[1]

        def work(x: np.ndarray) -> np.ndarray:
            z = centre(x) @ projection
            return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

        got = self._sum(work, k * k + k) / self.n
        mean = got[k * k:]
        return float(np.abs(got[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _added(rows: pd.DataFrame, length: int | None = None):
    """Sum of packed arrays by the order of their labels; packed again without ``length``."""
    rows = rows.sort_values("first")
    parts = [np.frombuffer(d, np.float64) for d in rows["data"]]
    total = np.sum(parts, axis=0) if parts else np.zeros(length or 0)
    if length is not None:
        return total
    return pd.DataFrame({"first": [rows["first"].iloc[0]], "data": [total.tobytes()]})


def _deviations(y: np.ndarray) -> pa.Array:
    """Sums of squares of whole numbers, null beyond a long."""
    if y.size and np.abs(y.astype(np.float64)).max() ** 2 * y.shape[1] >= 2.0 ** 62:
        exact = [sum(v * v for v in row) for row in y.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
    return pa.array((y * y).sum(axis=1))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS, inner: int = INNER) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every usable row
    and component. ``whitened`` is the centred vector on a unit eigenvector over the root of its
    eigenvalue, ``explained`` the eigenvalue's share of the total variance, ``deviation`` the exact
    sum of squares of ``n`` times the vector less the fit list's sums."""
    spark = rows.sparkSession
    ship_package(spark)
    usable = stage(rows.filter(finite_vector(vector)).select(
        F.col(key).alias("key"), integers(vector).alias("x")), "whiten-rows")
    lengths = usable.groupBy(F.size("x").alias("dim")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    dim = common["dim"] if common else 0
    usable = usable.filter(F.size("x") == dim)
    key_type = usable.schema["key"].dataType.simpleString()
    none = spark.createDataFrame(
        [], f"`{key}` {key_type}, component int, n long, deviation long, whitened double, "
        "explained double, identity_error double")
    if not dim:
        return none
    blocks = stage(_blocks(usable.select("x").distinct(), dim), "whiten-blocks")
    fit = FitList(blocks, dim, scan_partitions(blocks))
    fit.measure()
    trace = fit.trace()
    if fit.n < 2 or not trace > 0:
        return none
    values, axes = largest_pairs(fit.product, dim, min(components, fit.n - 1), inner)
    real = values > 64 * _EPS * trace
    values, axes = values[real], axes[:, real]
    projection = axes / np.sqrt(values)
    error = fit.identity_error(projection)
    centre, n, base, rest = fit.centre(), fit.n, fit.base, fit.rest

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            z = centre(x) @ projection
            far = x - base
            small = np.abs(far).max(initial=0) < (1 << 62) // n
            y = far * n - rest if small else far.astype(object) * n - rest
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _deviations(y), pa.array(list(z), pa.list_(pa.float64()))],
                names=["key", "deviation", "z"])

    scored = usable.select("key", "x").mapInArrow(
        project, f"key {key_type}, deviation long, z array<double>")
    share = F.array(*[F.lit(float(v / trace)) for v in values])
    return scored.select("key", "deviation", F.posexplode("z").alias("at", "whitened")).select(
        F.col("key").alias(key), (F.col("at") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"))
