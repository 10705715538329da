"""Whitening of embeddings by shifted Cholesky QR.

Vectors become integers, floor(scale * c) + offset. Each distinct one, once, makes the fit list, written to the shared folder: n rows with exact
sums S. The centred rows A = x - S/n are never gathered. A Gram pass sums A'A over the tasks, each of which adds up its own rows, in a
tree; the driver factors the d x d sum into R'R by Cholesky, and the next pass orthogonalises the rows further by a triangular solve
with all factors so far. The first sum is shifted by a little of its trace, so that the factoring holds however ill conditioned the rows are; two
passes more take the shift's error out. The factors composed, R = R3 R2 R1, are to A what a QR decomposition gives, so the singular values and
right vectors of R are those of A: components are its right vectors, eigenvalues of the covariance its squared singular values over n.
Where rows do not span all dimensions, Q'Q is no identity in the end; its root is put before R, which makes the same hold.

The driver and each task hold d x d numbers (32 KB at 64 dimensions, 134 MB at 4,096); nothing there grows with the rows.

Vectors null or with null or non-finite components drop out. Vectors of each length are fitted apart; empty ones have no components and
give no rows. Null ids stay, repeated rows each give theirs. Components without variance: explained 0, whitened null, and not
part of identity_error. n * x beyond 64 bits, or a deviation beyond them, is an error. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.shared import give_back, stored

PASSES = 3
BLOCK_COMPONENTS = 2_000_000
LONGS = 2**63 - 1
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """What a fit gives: sums and number of the fit list, components (columns) by falling eigenvalue."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float


def integers(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """(vec_id, x) of the rows that stay."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))) + F.lit(offset))
    return vectors.where(fine).select("vec_id", x.alias("x"))


def matrices(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of column x, a bounded number of components at a time."""
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    step = max(1, BLOCK_COMPONENTS // dims)
    for at in range(0, len(flat), step):
        yield at, flat[at : at + step]


def summed(rows: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """The sum of ``part`` over blocks of rows: one array a task, added up in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero.copy()
        for batch in batches:
            for _, block in matrices(batch, dims):
                total += part(block)
        give_back()
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    def added(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, zero.dtype) + np.frombuffer(b, zero.dtype)).tobytes()

    totals = rows.select("x").mapInArrow(run, "total binary").rdd.map(lambda r: bytes(r["total"]))
    return np.frombuffer(totals.treeReduce(added, depth=3), zero.dtype).reshape(zero.shape)


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper R with R'R = gram + shift * I; the shift grows until there is one. Rows that are all zero leave nothing to factor."""
    least = np.finfo(float).eps * np.trace(gram)
    while least > 0:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, least)
    return np.eye(len(gram))


def fit(fitted: DataFrame, dims: int, count: int) -> Whitening:
    """The whitening of a non-empty fit list (x), all of ``dims`` dimensions, that gives the first ``count`` components."""
    first = summed(fitted, dims, lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), np.zeros(dims + 1, np.int64))
    n, sums = int(first[0]), first[1:]
    mean = sums / n

    def gram(right: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            q = (x - mean) @ right
            return q.T @ q

        return summed(fitted, dims, part, np.zeros((right.shape[1],) * 2))

    r, inverse = np.eye(dims), np.eye(dims)
    for k in range(PASSES):
        g = gram(inverse)
        # 11 (mn + n(n + 1)) u times the squared norm, the usual shift; the trace is a bound of that norm.
        shift = 11 * (n * dims + dims * (dims + 1)) * np.finfo(float).eps / 2 * np.trace(g) if k == 0 else 0.0
        r = factor(g, min(shift, np.trace(g) * 1e-3)) @ r
        inverse = np.linalg.solve(r, np.eye(dims))
    g = gram(inverse)
    values, turn = np.linalg.eigh(g)
    _, sigma, components = np.linalg.svd((turn * np.sqrt(np.maximum(values, 0))) @ turn.T @ r)
    eigenvalues = sigma**2 / n
    eigenvalues[eigenvalues <= eigenvalues.max(initial=0) * dims * np.finfo(float).eps] = 0.0
    components, eigenvalues, total = components.T[:, :count], eigenvalues[:count], eigenvalues.sum()
    held = np.flatnonzero(eigenvalues)
    error = 0.0
    if len(held):
        error = float(np.abs(gram(components[:, held] / np.sqrt(eigenvalues[held])) / n - np.eye(len(held))).max())
    return Whitening(n, sums, components, eigenvalues, eigenvalues / total if total else np.zeros(len(eigenvalues)), error)


def deviations(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Sum over dimensions of (n * x - S)**2, exactly."""
    most = model.n * int(np.abs(x).max(initial=0)) + int(np.abs(model.sums).max(initial=0))
    if most > LONGS:
        raise OverflowError("n * x is beyond 64 bits")
    apart = x * model.n - model.sums
    if x.shape[1] * int(np.abs(apart).max(initial=0)) ** 2 <= LONGS:
        return (apart * apart).sum(axis=1)
    exact = [sum(v * v for v in row) for row in apart.tolist()]
    if max(exact) > LONGS:
        raise OverflowError("a deviation is beyond 64 bits")
    return np.array(exact, np.int64)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """WHITENED rows of (vec_id, x)."""
    mean, k = model.sums / model.n, len(model.eigenvalues)
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = np.where(model.eigenvalues > 0, model.components / np.sqrt(model.eigenvalues), np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, len(mean)):
                ids = batch.column("vec_id").slice(at, len(x)).take(pa.array(np.repeat(np.arange(len(x)), k)))
                values = pa.array(((x - mean) @ matrix).ravel(), from_pandas=True)
                one = lambda v, kind: pa.array(np.full(len(ids), v, kind))
                parts = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), one(model.n, np.int64), pa.array(np.repeat(deviations(x, model), k)), values]
                parts += [pa.array(np.tile(model.explained, len(x))), one(model.identity_error, float)]
                yield pa.RecordBatch.from_arrays([ids, *parts], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
        give_back()

    return rows.select(F.col("vec_id").cast("long"), "x").mapInArrow(run, WHITENED)


def whiten(spark: SparkSession, vectors: DataFrame, folder: str, count: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """WHITENED rows: each remaining row of (vec_id, embedding) on the first ``count`` components."""
    rows = integers(vectors, scale, offset)
    fitted = stored(rows.select("x").distinct(), f"{folder}/fitted")
    sizes = [r["dims"] for r in fitted.select(F.size("x").alias("dims")).distinct().collect()]  # a row per length
    found = spark.createDataFrame([], WHITENED)
    for d in sorted(s for s in sizes if s):
        of = F.size("x") == d
        found = found.unionByName(whitened(rows.where(of), fit(fitted.where(of), d, count)))
    return found
