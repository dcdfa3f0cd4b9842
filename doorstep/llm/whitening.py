"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Three passes over the rows. The first adds up the integer entries of every dimension, exactly. The
second adds up one d x d scatter of centred rows for each task, d being the length of a vector; the
driver gets one such matrix, whose size the vectors' length fixes, not the number of rows. There the
scatter is factored as P L L' P' with the largest remaining diagonal entry as pivot, and the columns
of the triangular L are rotated pairwise until all are orthogonal: their squared norms are the
eigenvalues and the normalised columns, with rows put back in order, the components. The third pass
projects the rows. The covariance of what it wrote is measured natively, with the centred updates of
``covar_pop``.

Defined results: null vectors and vectors with a null or non-finite component take no part, and
neither do those whose components exceed ``LARGEST`` in size. All vectors taking part have one
length, the one that most rows have (the greater of two equally frequent ones); rows of other lengths
take no part. Repeated rows are rows of their own and null ids are kept. Equal eigenvalues give one
of their orthogonal bases, the same for all rows. Components whose eigenvalue is below the rounding
error of the largest (dimensions without variance, fewer rows than dimensions) can't be whitened and
have no rows; equal rows only, one row only, empty vectors only and an empty table give no rows at
all. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blob_sum, staged, table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Entries are exact in 64 bits, and so are sums of a batch of them, below 1024 * 2**30.
LARGEST = 2.0 ** 30
#: Rotations stop when all cosines are below this, after ``SWEEPS`` rounds at the latest.
ORTHOGONAL, SWEEPS = 1e-15, 60
CHUNK = 4096


def entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat float64 entries of a list column, where each row starts and ends, and which rows are whole.

    A row is whole if it isn't null and no entry is null, non-finite or above ``LARGEST``."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    first = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) <= LARGEST))])
    return flat, first, valid & (bad[first[1:]] == bad[first[:-1]])


def matrices(column: pa.Array, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer entries) of the whole rows of length d, ``CHUNK`` rows at a time."""
    flat, first, whole = entries(column)
    rows = np.flatnonzero(whole & (np.diff(first) == d))
    for at in range(0, len(rows), CHUNK):
        part = rows[at:at + CHUNK]
        values = flat[first[:-1][part][:, None] + np.arange(d)]
        yield part, np.floor(values * SCALE).astype(np.int64) + SHIFT


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension over the rows of the most frequent length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            flat, first, whole = entries(batch.column("v"))
            for d in np.unique(np.diff(first)[whole]).tolist():
                for rows, x in matrices(batch.column("v"), d):
                    n, s = total.get(d, (0, np.zeros(d, object)))
                    total[d] = n + len(rows), s + x.sum(axis=0).astype(object)
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * (d + 1), pa.int32()), pa.array(range(-1, d), pa.int32()),
                 pa.array([Decimal(n), *(Decimal(int(x)) for x in s)], pa.decimal128(38, 0))], ["d", "i", "s"])
    parts = staged(vectors.mapInArrow(run, "d int, i int, s decimal(38,0)"), "dimension-sums").groupBy("d", "i").agg(
        F.sum("s").alias("s"))
    most = parts.where("i = -1").orderBy(F.desc("s"), F.desc("d")).first()
    if most is None:
        return 0, []
    found = {r["i"]: int(r["s"]) for r in parts.where(F.col("d") == most["d"]).collect()}  # one vector
    return found[-1], [found[i] for i in range(most["d"])]


def _centre(n: int, s: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Integers m and the small rest of the mean beyond them: S = n m + rest."""
    m = [(2 * x + n) // (2 * n) for x in s]
    return np.array(m, np.int64), np.array([x - n * y for x, y in zip(s, m, strict=True)], np.int64)


def scatter(vectors: DataFrame, n: int, s: list[int]) -> np.ndarray:
    """Covariance (divisor n) of the integer entries; every row is centred before it is multiplied."""
    d = len(s)
    m, rest = _centre(n, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in matrices(batch.column("v"), d):
                y = (x - m) - rest / n
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])
    return blob_sum(vectors.mapInArrow(run, "v binary")).reshape(d, d) / n


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order p and lower-triangular L (d x rank) with v[p][:, p] = L L', largest pivots first."""
    a, d = v.copy(), len(v)
    order = np.arange(d)
    least = d * np.finfo(float).eps * max(v.diagonal().max(initial=0.0), 0.0)
    low = np.zeros((d, d))
    for k in range(d):
        j = k + int(np.argmax(a.diagonal()[k:]))
        if not a[j, j] > least:
            return order, low[:, :k]
        order[[k, j]], low[[k, j]] = order[[j, k]], low[[j, k]]
        a[[k, j]] = a[[j, k]]
        a[:, [k, j]] = a[:, [j, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1:, k] = a[k + 1:, k] / low[k, k]
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return order, low


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs (a round-robin tournament)."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[:len(ring) // 2], ring[::-1], strict=False) if a < n and b < n]
        if pairs:
            yield np.array([min(p) for p in pairs]), np.array([max(p) for p in pairs])
        ring = [ring[0], ring[-1], *ring[1:-1]]


def jacobi(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms, falling, and unit vectors of the columns of ``low`` rotated to be orthogonal."""
    g = low.T.copy()  # a row for each column
    plan = list(rounds(len(g)))
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in plan:
            x, y = g[p], g[q]
            a, b, c = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            size = np.sqrt(a * b)
            turn = np.abs(c) > ORTHOGONAL * size
            worst = max(worst, float((np.abs(c) / np.where(size > 0, size, 1)).max()))
            if not turn.any():
                continue
            zeta = (b - a)[turn] / (2 * c[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            cos = (1 / np.hypot(1, t))[:, None]
            sin = cos * t[:, None]
            g[p[turn]], g[q[turn]] = cos * x[turn] - sin * y[turn], sin * x[turn] + cos * y[turn]
        if worst <= ORTHOGONAL:
            break
    e = (g * g).sum(axis=1)
    order = np.argsort(-e, kind="stable")
    return e[order], g[order] / np.sqrt(e[order])[:, None]


def principal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and its unit eigenvectors as rows."""
    order, low = pivoted_cholesky(v)
    e, u = jacobi(low)
    full = e > len(v) * np.finfo(float).eps * e.max(initial=0.0)
    out = np.zeros((int(full.sum()), len(v)))
    out[:, order] = u[full]
    return e[full], out


def whitened(docs: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error)."""
    vectors = docs.select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    n, s = sums(vectors.select("v"))
    kind = vectors.schema["id"].dataType.simpleString()
    cov = scatter(vectors.select("v"), n, s) if s else np.zeros((0, 0))
    values, axes = principal(cov)
    values, axes = values[:components], axes[:components]
    k, d = axes.shape[0], len(s)
    if not k:
        return docs.sparkSession.createDataFrame([], f"""vec_id {kind}, component int, n bigint,
            deviation decimal(38,0), whitened double, explained double, identity_error double""")
    m, rest = _centre(n, s)
    root, rest_sum = np.sqrt(values), sum(int(x) ** 2 for x in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("v"), d):
                y = x - m
                # the sum of (n y - rest)**2 over the dimensions; only the last steps need long integers
                square, cross = (y.astype(object) ** 2).sum(axis=1), (y.astype(object) * rest.astype(object)).sum(axis=1)
                far = [n * n * int(a) - 2 * n * int(b) + rest_sum for a, b in zip(square, cross, strict=True)]
                w = (y - rest / n) @ axes.T / root
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(rows)), pa.array([Decimal(a) for a in far], pa.decimal128(38, 0)),
                     *(pa.array(np.ascontiguousarray(w[:, j])) for j in range(k))], ["id", "deviation", *(f"w{j}" for j in range(k))])
    rows = staged(vectors.mapInArrow(run, ", ".join(
        [f"id {kind}, deviation decimal(38,0)", *(f"w{j} double" for j in range(k))])), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    measured = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = values / np.trace(cov)
    return rows.select("id", "deviation", F.inline(F.array(*[
        F.struct(F.lit(j + 1).alias("component"), F.col(f"w{j}").alias("whitened"), F.lit(float(share[j])).alias("explained"))
        for j in range(k)]))).select(
        F.col("id").alias("vec_id"), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
        F.lit(float(error)).alias("identity_error"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that doesn't fit in a long is null; the operator itself gives it as a decimal."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
