"""Embedding whitening by Chebyshev-filtered subspace iteration.

A vector's entries become whole numbers x (floor of 256 times the entry). The model is fitted on each
distinct x once: n vectors, their sums S, and the leading eigenpairs of their covariance V, which is
never formed. What runs on Spark is one pass per product V Q = XᵀXQ / n over blocks of the centred
vectors: every task adds up its own share, Spark sums the shares, and d times the width of Q numbers reach the driver.

A round multiplies the block Q by a Chebyshev polynomial of V, whose recurrence takes one pass per
degree. On the unwanted spectrum, from 0 to the smallest Ritz value of the block, the polynomial stays small, above it
grows; so after QR the block leans to the leading eigenvectors, and a Rayleigh-Ritz step takes the best
eigenpairs out of it. Rounds end when the wanted pairs are certified: each residual |Vq - eq|, which bounds the error
of e and, over the gap to its neighbours, the angle of q, is down to rounding. A block that is not
certified after ROUNDS rounds is doubled; one as wide as V makes Rayleigh-Ritz exact.

Defined results: rows whose vector is null, empty, or has null or non-finite entries or entries of 2**32 or more are
dropped; so are vectors of another than the most frequent length. A row without vec_id, repeated rows
and repeated vec_ids get rows each. Components with an eigenvalue of zero (up to rounding) have no unit variance to
scale to and are left out: a table of equal vectors, and an empty table, give no rows. Equal eigenvalues:
any orthonormal basis of their space, the same one for all rows. A deviation beyond a long is null. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch, table
from .vectors import common_length, scaled

COMPONENTS = 4
LIMIT = float(1 << 32)
#: Numbers in a stored block of vectors.
BLOCK_VALUES = 1 << 18
#: Largest degree of the filter; how much more than the last wanted one the first eigenvector may grow in a round.
DEGREE, SPREAD = 12, 1e8
ROUNDS = 10
#: Residuals relative to the largest eigenvalue: certified at the first; at the second if they no longer halve.
CERTIFIED, ROUNDING = 1e-14, 1e-11
#: Eigenvalues below this share of the largest count as zero.
ZERO = 1e-12


@dataclass
class Whitening:
    """n, integer sums, eigenvalues (falling), eigenvectors (columns), trace of V, and how they were certified."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0


def _block_batches(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, BLOCK_VALUES // d)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().astype("<i8").reshape(-1, d)
            parts = [x[k:k + rows] for k in range(0, len(x), rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(p) for p in parts], pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["n", "x"])
    return run


def summed(blocks: DataFrame, d: int, share: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all blocks of ``share(block)``, an array of ``size`` numbers; added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for raw in batch.column(0):
                total += share(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["pos", "value"])

    out = np.zeros(size)
    for pos, value in blocks.select("x").mapInArrow(run, "pos int, value double").groupBy("pos").agg(F.sum("value")).collect():
        out[pos] = value
    return out


def column_sums(blocks: DataFrame, d: int) -> list[int]:
    """Exact sum of every dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                s = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, d).sum(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(s)], ["pos", "value"])

    out = [0] * d
    rows = blocks.select("x").mapInArrow(run, "pos int, value long") \
        .groupBy("pos").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect()
    for pos, s in rows:
        out[pos] = int(s)
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: whole parts are subtracted as integers, so only the last step rounds."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole) - rest


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, top: float, cut: float, degree: int) -> np.ndarray:
    """p(V) q for the Chebyshev polynomial on [0, cut] of this degree, scaled to 1 at ``top``. ``vq`` is V q."""
    half = cut / 2
    first = scale = half / (top - half)
    last, now = q, (vq - half * q) * (first / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        last, now = now, (apply(now) - half * now) * (2 * following / half) - last * (scale * following)
        scale = following
    return now


def leading_eigenpairs(apply: Callable[[np.ndarray], np.ndarray], d: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors and residuals of the ``count`` leading pairs of a positive semidefinite matrix."""
    rng = np.random.default_rng(20240607)
    count = min(count, d)
    width = min(d, max(2 * count, count + 8))
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before, rounds = np.inf, 0
    while True:
        vq = apply(q)
        h = q.T @ vq
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        residuals = np.linalg.norm(vq - q * e, axis=0)[:count]
        worst, top = residuals.max(), e[0]
        if width == d or top <= 0 or worst <= CERTIFIED * top or (worst <= ROUNDING * top and worst > before / 2):
            return e[:count], q[:, :count], residuals
        before, rounds = worst, rounds + 1
        if rounds % ROUNDS == 0:
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((d, min(d, 2 * width) - width))]))[0]
            width, before = q.shape[1], np.inf
            continue
        cut = max(e[-1], ZERO * top)
        wanted = max(e[count - 1], cut)
        spread = np.arccosh(2 * top / cut - 1) - np.arccosh(2 * wanted / cut - 1)
        degree = int(np.clip(np.log(SPREAD) / spread if spread > 0 else DEGREE, 1, DEGREE))
        q = np.linalg.qr(filtered(apply, q, vq, top, cut, degree))[0] if cut < top else q


def fit(rows: DataFrame, scratch: Scratch, d: int, count: int = COMPONENTS) -> Whitening | None:
    """The model of the distinct x (length d) of ``rows``; None without rows."""
    blocks = scratch.write(rows.select("x").distinct().mapInArrow(_block_batches(d), "n long, x binary"), "blocks")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = column_sums(blocks, d)
    trace = summed(blocks, d, lambda x: (centred(x, n, sums) ** 2).sum(keepdims=True), 1)[0] / n
    passes = [0]

    def apply(q: np.ndarray) -> np.ndarray:
        def share(x: np.ndarray) -> np.ndarray:
            y = centred(x, n, sums)
            return y.T @ (y @ q)

        passes[0] += 1
        return summed(blocks, d, share, d * q.shape[1]).reshape(d, -1) / n

    values, vectors, residuals = leading_eigenpairs(apply, d, count)
    kept = values > max(ZERO * values[0], 0) if trace > 0 else np.zeros(len(values), bool)
    model = Whitening(n, sums, values[kept], vectors[:, kept], trace, residuals, passes[0])
    k = int(kept.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, model)
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    if k:
        got = summed(blocks, d, moments, k * k + k)
        mean = got[k * k:] / n
        model.identity_error = float(np.abs(got[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    return model


def _whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.vectors / np.sqrt(model.values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)**2, None beyond a long."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most * most * x.shape[1] < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _row_batches(model: Whitening, d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, model.n)), pa.array([v for v in deviations(x, model.n, model.sums) for _ in range(k)], pa.int64()),
                 pa.array(_whitened(x, model).ravel()), pa.array(np.tile(model.values / model.trace, m)),
                 pa.array(np.full(m * k, model.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, scratch: Scratch, count: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable row and component."""
    rows = scaled(vectors, LIMIT)
    d = common_length(rows)
    rows = rows.where(F.size("x") == d)
    model = fit(rows, scratch, d, count) if d else None
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], out)
    return rows.select("vec_id", "x").mapInArrow(_row_batches(model, d), out)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four leading whitened components of every embedding."""
    return whiten(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"))
