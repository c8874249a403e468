"""Embedding whitening by spectral divide-and-conquer.

The covariance of the distinct vectors is one aggregation of centred products. Its size is the square
of the dimension, whatever the number of rows, so it is decomposed on the driver: the polar factor of
the covariance less a shift is +1 on the subspace above the shift and -1 below, which gives the
projector on either; an orthogonal basis of both splits the matrix in two, and the halves are split
again until single components are left. Polar factors come from dynamically weighted Halley steps,
each one QR or Cholesky decomposition. The components are broadcast, and every row is whitened where
it lies."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.llm.common import ready, staged
from returnsight.llm.topk import finite, long_matrix, scaled
from returnsight.llm.vectors import doubles

EPS = np.finfo(float).eps
#: Rows that a task centres and multiplies at a time.
STEP = 4096


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iteration."""
    x = a / np.linalg.norm(a)
    try:  # the inverse's norm bounds the least singular value from below
        low = min(max(0.9 / np.linalg.norm(np.linalg.inv(x)), EPS), 1.0)
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(len(a))
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        p = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d))))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        if r > 100:
            basis = np.linalg.qr(np.vstack([np.sqrt(r) * x, eye]))[0]
            new = q / r * x + (p - q / r) / np.sqrt(r) * basis[: len(a)] @ basis[len(a) :].T
        else:
            lower = np.linalg.cholesky(eye + r * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            new = q / r * x + (p - q / r) * np.linalg.solve(lower.T, half).T
        moved, x = np.linalg.norm(new - x), (new + new.T) / 2
        low = min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if moved <= np.cbrt(EPS) * 1e-2 and abs(1 - low) <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, int]:
    """An orthogonal basis whose first ``k`` columns span the invariant subspace of the symmetric
    matrix ``a`` above some shift, and k, neither part being empty; k is 0 if no shift parts it."""
    n, size = len(a), np.linalg.norm(a)
    diagonal, middle = np.sort(np.diag(a)), np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n)) / np.sqrt(n)  # some eigenvalue is this far away
    shifts = [np.median(diagonal), middle, *(middle + spread * s for s in (0.1, -0.1, 0.3, -0.3, 0.6, -0.6, 0.9, -0.9))]
    best = (np.inf, np.eye(n), 0)
    for shift in [*shifts, *((diagonal[1:] + diagonal[:-1]) / 2)]:
        moved = a - shift * np.eye(n)
        if np.linalg.norm(moved) <= EPS * size:
            continue
        projector = (polar_factor(moved) + np.eye(n)) / 2
        k = int(round(np.trace(projector)))
        if not 0 < k < n:
            continue
        basis = _basis(projector, k)
        rest = np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k])
        if rest < best[0]:
            best = (rest, basis, k)
        if rest <= 10 * n * EPS * size:
            break  # else the shift is all but an eigenvalue: try another
    return best[1], best[2]


def _basis(projector: np.ndarray, k: int) -> np.ndarray:
    """An orthogonal matrix whose first ``k`` columns span the projector's range."""
    n = len(projector)
    columns, other = np.random.default_rng(n).normal(size=(n, n)), np.eye(n) - projector
    for _ in range(3):
        columns = np.linalg.qr(np.column_stack([projector @ columns[:, :k], other @ columns[:, k:]]))[0]
    return columns


def components_of(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors in
    columns. Subspaces below those wanted are not split further."""
    size = np.linalg.norm(a)

    def descend(basis: np.ndarray, wanted: int) -> np.ndarray:
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        n = len(own)
        if n <= 1 or wanted <= 0:
            return basis[:, : max(0, wanted)]
        if np.linalg.norm(own - np.trace(own) / n * np.eye(n)) <= n * EPS * size:
            return basis[:, :wanted]  # one eigenvalue: any basis of the subspace will do
        part, k = _split(own)
        if k == 0:
            return basis[:, :wanted]
        upper = descend(basis @ part[:, :k], wanted)
        if upper.shape[1] >= wanted:
            return upper
        return np.column_stack([upper, descend(basis @ part[:, k:], wanted - upper.shape[1])])

    vectors = descend(np.eye(len(a)), min(count, len(a)))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    mean: np.ndarray
    vectors: np.ndarray  # dimensions by components
    values: np.ndarray
    explained: np.ndarray
    error: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)


def _sums(dim: int):
    """Tasks over (x): sums of each dimension in two halves of 32 bits, which no task can overflow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            x = long_matrix(batch.column(0), dim)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dim, n))], ["i", "high", "low", "n"])

    return run


def _products(dim: int, width: int, values):
    """Tasks over (x): sums of products of ``values(x)``, one row for each pair i <= j, and with j = -1
    the sums themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, plain = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            x = long_matrix(batch.column(0), dim)
            for lo in range(0, len(x), STEP):
                d = values(x[lo : lo + STEP])
                square += d.T @ d
                plain += d.sum(axis=0)
        i, j = np.triu_indices(width)
        i, j = np.concatenate([i, np.arange(width)]), np.concatenate([j, np.full(width, -1)])
        sums = np.concatenate([square[np.triu_indices(width)], plain])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums)], ["i", "j", "value"])

    return run


def _covariance(rows: DataFrame, n: int, dim: int, width: int, values) -> np.ndarray:
    """Covariance, divisor n, of ``values(x)``, which are centred already: what rounding has left of
    their mean is taken off once more."""
    summed = rows.mapInArrow(_products(dim, width, values), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (summed.column(c).to_numpy() for c in range(3))
    square, mean = np.zeros((width, width)), np.zeros(width)
    pair = j >= 0
    square[i[pair], j[pair]] = square[j[pair], i[pair]] = value[pair] / n
    mean[i[~pair]] = value[~pair] / n
    return square - np.outer(mean, mean)


def fit(distinct: DataFrame, dim: int, count: int) -> Whitening | None:
    """Whitening by the ``count`` leading components of the distinct vectors (column x); None without
    rows or variance. Components whose variance is zero up to rounding are left out."""
    sums = distinct.mapInArrow(_sums(dim), "i int, high long, low long, n long").groupBy("i")
    sums = sums.agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "n"))).collect()
    if not sums or not sums[0]["n"]:
        return None
    n = int(sums[0]["n"])
    by_dim = {r["i"]: (int(r["high"]) << 32) + int(r["low"]) for r in sums}
    exact = [by_dim[i] for i in range(dim)]
    mean = np.array([s / n for s in exact])
    v = _covariance(distinct, n, dim, dim, lambda x: x - mean)
    trace = float(np.trace(v))
    values, vectors = components_of(v, count) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    real = values > dim * EPS * max(values, default=0.0)
    values, vectors = values[real], vectors[:, real]
    if not len(values):
        return None
    own = Whitening(n, exact, mean, vectors, values, values / trace, 0.0)
    check = _covariance(distinct, n, dim, len(values), own.whitened)
    return own._replace(error=float(np.abs(check - np.eye(len(values))).max()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exact; None where a long cannot hold them."""
    most = n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max(map(abs, sums))
    if most * most * x.shape[1] < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
    return [d if d < 2**63 else None for d in exact.tolist()]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _applied(dim: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Whitening = shared.value
        c = len(own.values)
        for batch in batches:
            x = long_matrix(batch.column(1), dim)
            m = len(x)
            row = np.repeat(np.arange(m), c)
            deviation = pa.array(_deviations(x, own.n, own.sums), pa.int64()).take(pa.array(row))
            columns = [batch.column(0).take(pa.array(row)), np.tile(np.arange(1, c + 1, dtype=np.int32), m), np.full(m * c, own.n), deviation, own.whitened(x).ravel(), np.tile(own.explained, m), np.full(m * c, own.error)]
            yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in columns], [f.split()[0] for f in RESULT.split(", ")])

    return run


def whiten(rows: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """Each row's coordinates on the leading components of the table, divided by their deviations:
    vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries count as x = floor(scale * c). Rows whose vector is null or holds a null or non-finite
    entry drop out; rows without an id stay, with a null vec_id, and repeated rows are whitened one by
    one. Shorter vectors count as padded with zeros. Means and covariances are over the distinct x, n
    of them with sums S. deviation is the sum of (n * x - S)^2 over the dimensions, null where a long
    cannot hold it. Components without variance are left out, so a table whose vectors are all equal
    gives no rows, as an empty table does. Other columns are ignored."""
    spark = ready(rows).sparkSession
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles(F.col("embedding")).alias("vector")).where(finite(F.col("vector")))
    own = valid.select("vec_id", scaled(F.col("vector"), scale).alias("x"))
    dim = own.agg(F.max(F.size("x"))).first()[0] or 0
    # shorter vectors are equal to their padded form
    distinct = staged(own.select(_padded("x", dim)).distinct(), "distinct-vectors")
    fitted = fit(distinct, dim, components) if dim else None
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    shared = spark.sparkContext.broadcast(fitted)
    return own.mapInArrow(_applied(dim, shared), RESULT)


def _padded(name: str, dim: int):
    x = F.col(name)
    return F.when(F.size(x) < dim, F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(x)))).otherwise(x).alias(name)
