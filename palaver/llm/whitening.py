"""Whitening of embeddings: principal components by matrix-free block Lanczos over distributed passes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, staged_rows

#: Entries are multiplied by this and rounded down before anything else.
SCALE = 256
#: A Ritz pair counts when its residual is below this share of the largest Ritz value.
TOLERANCE = 1e-13
#: Columns of the basis after which it shrinks to the best Ritz vectors; the driver holds twice as many vectors.
MAX_BASIS = 160
MAX_PASSES = 1_000
#: Eigenvalues below this share of the largest are no components: there is nothing to divide by.
LEAST = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---- the method on the driver: small dense blocks, all products with the matrix from outside ----------------


def fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, size: float) -> np.ndarray:
    """`block` made orthonormal and orthogonal to `basis`; a column of which nothing is left is started anew at random.

    `size` is the length against which a column counts as nothing. There are fewer columns if the space is full.
    """
    done = basis
    for column in block.T:
        least = 1e-10 * size
        for _ in range(20):
            if done.shape[1] == done.shape[0]:
                return done[:, basis.shape[1] :]
            v = column.copy()
            for _ in range(2):  # once is not enough where much is taken off
                v -= done @ (done.T @ v)
            length = np.linalg.norm(v)
            if length > least:
                v /= length
                v -= done @ (done.T @ v)
                done = np.column_stack([done, v / np.linalg.norm(v)])
                break
            column, least = rng.normal(size=len(column)), 1e-6
    return done[:, basis.shape[1] :]


def lanczos(apply: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7, tolerance: float = TOLERANCE, most: int = MAX_BASIS) -> tuple[np.ndarray, np.ndarray]:
    """The `k` largest eigenvalues, falling, and unit eigenvectors of a symmetric matrix known by its products only.

    Block Lanczos with full reorthogonalisation: each round takes one product with a block of k vectors. It ends when
    the residuals of the k best Ritz pairs are small, or the basis spans everything. A breakdown (a block that brings
    nothing new) is restarted with random directions, a basis of more than `most` columns with the best Ritz vectors.
    """
    k = min(k, d)
    rng = np.random.default_rng(seed)
    basis = image = np.zeros((d, 0))
    block = fresh(rng.normal(size=(d, k)), basis, rng, 1.0)
    for _ in range(MAX_PASSES):
        product = apply(block)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        best = basis @ turn[:, :k]
        residual = np.linalg.norm(image @ turn[:, :k] - best * values[:k], axis=0)
        if basis.shape[1] == d or (residual <= tolerance * max(abs(values[0]), abs(values[-1]))).all():
            return values[:k], best / np.linalg.norm(best, axis=0)
        block = fresh(product, basis, rng, np.linalg.norm(product, axis=0).max())
        if basis.shape[1] > most:
            basis, image = basis @ turn[:, : 2 * k], image @ turn[:, : 2 * k]
    raise ArithmeticError("the eigenvalues did not converge")


# ---- the passes -------------------------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(fit: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray], length: int) -> np.ndarray:
    """Sum over the rows of `fit` of what `f` makes of blocks of them: added up in each task, then in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for b in batches:
            if b.num_rows:
                total += f(_matrix(b.column(0), d)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length), pa.int32()), pa.array(total)], ["at", "part"])

    rows = fit.select("x").mapInArrow(run, "at int, part double").groupBy("at").agg(F.sum("part").alias("part")).collect()  # `length` rows
    out = np.zeros(length)
    for r in rows:
        out[r["at"]] = r["part"]
    return out


@dataclass(frozen=True)
class Model:
    """What `fit` learns: n vectors with sums `sums`, eigenvalues (falling), their unit eigenvectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int | None]]:
    """Of each row the sum of (n * x - sums)^2: as double, and exact; None where that does not fit in 64 bits."""
    wide = max(abs(s) for s in sums) < 1 << 61 and (not x.size or int(np.abs(x.astype(float)).max()) * n < 1 << 61)
    if not wide:
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return np.array([float(v) for v in exact]), [v if v < 1 << 63 else None for v in exact]
    off = n * x - np.array(sums, np.int64)
    about = (off.astype(float) ** 2).sum(1)
    fits = about < 9.2e18  # the sum of squares is then below 2**63, and so is each part of it
    exact = np.where(fits[:, None], off, 0)
    exact = (exact * exact).sum(1)
    found = [int(v) if ok else None for v, ok in zip(exact, fits, strict=True)]
    for i in np.flatnonzero(~fits & (about < 9.3e18)):
        v = sum(int(u) ** 2 for u in off[i])
        found[i] = v if v < 1 << 63 else None
    return about, found


def integers(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows, staged, and the length of the vectors.

    Left out are vectors that are null or empty, hold null or non-finite entries, or have another length than most have
    (of equally many the shorter). Entries beyond 64 bits become the nearest long.
    """
    c = F.col("embedding").cast("array<double>")
    sound = F.coalesce((F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = embeddings.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * float(scale))).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = top["d"] if top else 0
    return staged(rows.where(F.size("x") == d), "whitening-rows"), d


def fit(rows: DataFrame, d: int, k: int = 4) -> Model | None:
    """Principal components of the distinct vectors of `rows`; None if there is no vector, or no variance.

    Distinct vectors are staged once and read by each pass: one for each product of the block Lanczos method, two for
    the trace and for what whitening leaves of the identity. Only sums of fixed size reach the driver.
    """
    if not d:
        return None
    # a vector that many rows have is one row before the shuffle
    distinct, n = staged_rows(rows.select("x").distinct(), "whitening-fit")
    sums = [int(r["s"]) for r in distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).orderBy("at").collect()]  # d rows
    mean = np.array([s / n for s in sums])

    def product(block: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return summed(distinct, d, of, block.size).reshape(block.shape) / n

    values, vectors = lanczos(product, d, k)
    real = (values > LEAST * values[0]) & (values > 0)
    values, vectors = values[real], vectors[:, real]
    if not values.size:
        return None
    model = Model(n, sums, values, vectors, 0.0, 0.0)
    m = values.size
    first = summed(distinct, d, lambda x: np.r_[deviations(x, n, sums)[0].sum(), model.whitened(x).sum(0)], 1 + m)
    middle = first[1:] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x) - middle
        return w.T @ w

    error = np.abs(summed(distinct, d, spread, m * m).reshape(m, m) / n - np.eye(m)).max()
    return Model(n, sums, values, vectors, first[0] / float(n) ** 3, float(error))


def whiten(rows: DataFrame, d: int, model: Model) -> DataFrame:
    """A row for each row of `rows` and component, in the columns of SCHEMA. No shuffle."""
    share = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.values.size
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), d)
                of = np.repeat(np.arange(b.num_rows), m)
                _, exact = deviations(x, model.n, model.sums)
                cols = [b.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, m + 1), b.num_rows), pa.int32()), pa.array(np.full(of.size, model.n)), pa.array(exact, pa.int64()).take(pa.array(of))]
                cols += [pa.array(model.whitened(x).ravel()), pa.array(np.tile(share, b.num_rows)), pa.array(np.full(of.size, model.identity_error))]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def whitened(embeddings: DataFrame, k: int = 4) -> DataFrame:
    """The rows of `embeddings` with usable vectors (see `integers`), whitened along up to `k` components.

    Columns: vec_id, component (from 1, by falling eigenvalue), n (distinct vectors), deviation (exact; null if it does
    not fit in 64 bits), whitened, explained (share of the trace), identity_error. A row with a null or repeated id is a
    row like others; equal vectors count once in the fit. There are fewer than `k` components where the vectors span
    fewer dimensions, and no rows where none do: with no vector, or one. Labels and other columns do not matter.
    """
    rows, d = integers(embeddings)
    model = fit(rows, d, k)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    if not math.isfinite(model.trace):
        raise ArithmeticError("the variance of the vectors is beyond double precision")
    return whiten(rows, d, model)
