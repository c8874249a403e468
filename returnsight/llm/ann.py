"""Nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors are lengthened by one coordinate to equal norms, which turns the largest inner product into
the smallest distance, and rotated at random, so that any block of coordinates is a fair sample of a
distance. Centroids (k-means on a bounded sample in hash order) make inverted lists; a query probes
the lists nearest to it. Within a list the scan goes over blocks of columns: after each, a
hypothesis test on the partial distance abandons a candidate that would have to be an outlier to
still beat the query's k-th best, and only the rest reads the next block. What survives is scored
with the original vectors in double precision.

Equal vectors are one candidate and one query. Only the smallest k + 1 ids of a candidate can be
among k neighbours, ties going to the smaller id, so that is all it needs to keep. Candidates are
written once, list by list, lists longer than ``SEGMENT`` dealt out in segments. Queries are broadcast
in chunks of at most ``CHUNK_BYTES`` and pass a segment in blocks, so no task holds more than a segment,
a chunk and its best answers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returnsight.llm.common import chunked, ready, staged
from returnsight.llm.vectors import doubles, matrix, usable

#: Rows that centroids are fitted on, and the share of lists that a query probes.
FIT_ROWS, PROBED = 20_000, 0.75
#: Candidates of a list that a task scans together; queries that it passes over them at a time.
SEGMENT, BLOCK = 4096, 256
#: Bytes of query vectors that are broadcast at once.
CHUNK_BYTES = 32 << 20
#: Columns of a block; the hypothesis test's width in standard errors.
COLUMNS, EPSILON = 16, 2.1
#: With a smaller share of candidates left, the next columns are read for these alone.
DENSE = 0.15
#: Rows that a task gathers over its lists before it keeps each query's best and passes them on.
GATHERED = 400_000


class Index(NamedTuple):
    rotation: np.ndarray
    centroids: np.ndarray  # rotated
    longest: float  # largest squared norm

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        """Rotated candidates, all of the longest one's norm."""
        rest = np.sqrt(np.maximum(0.0, self.longest - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, rest]) @ self.rotation

    def rotated(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))]) @ self.rotation

    def distances(self, x: np.ndarray, lists: slice = slice(None)) -> np.ndarray:
        """Squared distances to the lists' centroids, less the squared norm of x."""
        return (self.centroids[lists] ** 2).sum(axis=1) - 2 * x @ self.centroids[lists].T

    def reach(self, x: np.ndarray, n: int) -> np.ndarray:
        """Distance of each query to the farthest of the ``n`` lists that it probes."""
        parts = [np.partition(self.distances(x[lo : lo + 1024]), n - 1, axis=1)[:, n - 1] for lo in range(0, len(x), 1024)]
        return np.concatenate([*parts, np.zeros(0)])


def fit(sample: np.ndarray, longest: float, lists: int, seed: int = 7, steps: int = 8) -> Index:
    dim = sample.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, dim + 1)))[0]
    x = Index(rotation, np.zeros((0, dim + 1)), longest).lengthened(sample)
    lists = max(1, min(lists, len(x)))
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)]  # the sample is in hash order
    for _ in range(steps):
        near = np.argmin((centroids**2).sum(axis=1) - 2 * x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=lists)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], centroids)
    return Index(rotation, centroids, longest)


def adaptive_scan(queries: np.ndarray, candidates: np.ndarray, k: int, columns: int = COLUMNS, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs of rotated rows: the k nearest, up to what a test on a partial
    distance has abandoned wrongly."""
    n, dim = len(candidates), queries.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))

    norms = (candidates**2).sum(axis=1)

    def near(order: np.ndarray) -> np.ndarray:
        """The k-th best full distance among the candidates that look nearest by ``order``."""
        ahead = np.argpartition(order, min(n - 1, 2 * k), axis=1)[:, : 2 * k + 1]
        cross = np.matmul(candidates[ahead], queries[:, :, None])[:, :, 0]
        full = (queries**2).sum(axis=1)[:, None] + norms[ahead] - 2 * cross
        return np.partition(full, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12

    # while most candidates are in, a block is one matrix product over all of them
    partial = np.zeros((len(queries), n))
    for lo in range(0, dim, columns):
        q, c = queries[:, lo : lo + columns], candidates[:, lo : lo + columns]
        partial += (q**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * q @ c.T
        seen = min(lo + columns, dim)
        if lo == 0 and seen < dim:
            continue  # the bound is taken after two blocks
        if lo <= columns:
            bound = near(partial)
        alive = partial <= (bound * _allowance(seen, dim, epsilon))[:, None] + 1e-12
        if alive.mean() < DENSE:
            break
    i, j = np.nonzero(alive)
    sums = partial[i, j]
    for lo in range(seen, dim, columns):  # then only of what is left
        sums = sums + ((queries[i, lo : lo + columns] - candidates[j, lo : lo + columns]) ** 2).sum(axis=1)
        seen = min(lo + columns, dim)
        kept = sums <= bound[i] * _allowance(seen, dim, epsilon) + 1e-12
        i, j, sums = i[kept], j[kept], sums[kept]
    # of the full distances the k smallest, and what is as near up to rounding
    order = np.lexsort((sums, i))
    i, j, sums = i[order], j[order], sums[order]
    start, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    kept = sums <= sums[np.minimum(start + k - 1, end - 1)] * (1 + 1e-9) + 1e-9 if len(i) else np.zeros(0, bool)
    return i[kept], j[kept]


def _allowance(seen: int, dim: int, epsilon: float) -> float:
    """Share of a full squared distance up to which ``seen`` of ``dim`` coordinates raise no doubt."""
    return 1.0 + 1e-9 if seen >= dim else seen / dim * (1 + epsilon / np.sqrt(seen)) ** 2


FOUND = "query long, candidate long, score double"


class Queries(NamedTuple):
    index: Index
    reps: np.ndarray
    x: np.ndarray
    rotated: np.ndarray
    reach: np.ndarray

    def probing(self, number: int) -> np.ndarray:
        d = self.index.distances(self.rotated, slice(number, number + 1))[:, 0]
        return np.flatnonzero(d <= self.reach + 1e-9 * np.abs(self.reach) + 1e-12)


def _lists(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(list, reps, vectors) of rows (list, rep, vector) in the order of lists, ``SEGMENT`` at most."""
    number, reps, rows, held = None, [], [], 0
    for batch in batches:
        lists, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), dim)
        edges = np.flatnonzero(lists[1:] != lists[:-1]) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(lists)], strict=True):
            if held and (lists[lo] != number or held + hi - lo > SEGMENT):
                yield number, np.concatenate(reps), np.concatenate(rows)
                reps, rows, held = [], [], 0
            if hi > lo:
                number, held = int(lists[lo]), held + hi - lo
                reps.append(ids[lo:hi])
                rows.append(x[lo:hi])
    if held:
        yield number, np.concatenate(reps), np.concatenate(rows)


def _scan(dim: int, k: int, shared):
    """Tasks over rows (list, rep, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = shared.value
        found, rows = [], 0
        for number, ids, known in _lists(batches, dim):
            rotated, asking = queries.index.lengthened(known), queries.probing(number)
            for at in range(0, len(asking), BLOCK):
                some = asking[at : at + BLOCK]
                i, j = adaptive_scan(queries.rotated[some], rotated, k)
                score = np.einsum("ij,ij->i", queries.x[some[i]], known[j])
                found.append((queries.reps[some[i]], ids[j], score))
                rows += len(i)
            if rows > GATHERED:
                found = [_best(found, k)]
                rows = len(found[0][0])
                if rows > GATHERED // 2:
                    yield _found(found[0])
                    found, rows = [], 0
        if found:
            yield _found(_best(found, k))

    return run


def _found(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "candidate", "score"])


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """(query, candidate, score) of the k best of each query, and what ties with the last of them."""
    query, candidate, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((-score, query))
    query, candidate, score = query[order], candidate[order], score[order]
    start, end = np.searchsorted(query, query), np.searchsorted(query, query, side="right")
    kept = score >= score[np.minimum(start + k - 1, end - 1)] if len(score) else np.zeros(0, bool)
    return query[kept], candidate[kept], score[kept]


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    place = F.rank().over(Window.partitionBy("query").orderBy(F.col("score").desc()))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def nearest(rows: DataFrame, every: int = 20, k: int = 20, probed: float = PROBED) -> DataFrame:
    """The ``k`` rows of ``rows`` (vec_id, embedding) with the largest inner product found for each
    row whose vec_id ``every`` divides: query_id, rank, vec_id, score; ties go to the smaller id.

    Rows whose id is null, or whose vector is null, empty, zero or holds a null or non-finite
    component, take no part. Shorter vectors count as padded with zeros. A query never finds its own
    row; rows that repeat an id count once per different vector. With fewer candidates all are found.
    An empty table gives no rows; other columns are ignored."""
    spark = ready(rows).sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), doubles(F.col("embedding")).alias("vector")).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    reps = staged(own.groupBy("vector").agg(F.min("vec_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "vector-reps")
    total = reps.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).first()
    n, dim = total["n"], total["dim"] or 1
    # the only join by vector: from here on a vector is its number
    numbered = staged(own.join(reps.withColumnRenamed("vector", "of"), F.col("vector") == F.col("of")).select("vec_id", "rep"), "vector-ids").distinct()
    # of each vector the smallest k + 1 ids: no other can be among k neighbours
    place = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    named = staged(numbered.withColumn("place", place).where(F.col("place") <= k + 1).select(F.col("rep").alias("candidate"), "vec_id"), "smallest-ids")
    asked = staged(numbered.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")), "queries")

    sample = reps.orderBy(F.xxhash64("vector"), "first").limit(FIT_ROWS).select("vector").collect()
    x = np.array([np.pad(r["vector"], (0, dim - len(r["vector"]))) for r in sample]).reshape(-1, dim)
    lists = int(np.clip(np.ceil(np.sqrt(n) / 4), 1, 4096))
    index = fit(x, total["longest"] or 0.0, lists) if n else Index(np.eye(dim + 1), np.zeros((1, dim + 1)), 0.0)
    shared = spark.sparkContext.broadcast(index)
    probes = max(1, int(np.ceil(probed * len(index.centroids))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argmin(shared.value.distances(shared.value.lengthened(matrix(batch.column(1), dim))), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0), batch.column(1)], ["list", "rep", "vector"])

    listed = reps.select("rep", "vector").mapInArrow(assign, "list int, rep long, vector array<double>")
    sizes = listed.groupBy(F.col("list").alias("of_list")).agg(F.ceil(F.count("*") / SEGMENT).alias("segments"))
    sizes = F.broadcast(staged(sizes, "list-sizes"))  # 4096 rows at most
    dealt = listed.join(sizes, F.col("list") == F.col("of_list")).withColumn("segment", F.pmod(F.xxhash64("rep"), F.col("segments")))
    candidates = staged(dealt.repartition("list", "segment").sortWithinPartitions("list").select("list", "rep", "vector"), "candidates")
    different = asked.select("query").distinct()
    queries = staged(reps.join(different, F.col("rep") == F.col("query"), "left_semi").select("rep", "vector"), "query-vectors")
    chunk, chunks = chunked(queries, ["rep"], max(1, CHUNK_BYTES // (24 * (dim + 1))))
    found = []
    for number in range(chunks):
        part = queries.where(chunk == number).toArrow().combine_chunks()
        x = matrix(part.column("vector").combine_chunks(), dim)
        rotated = index.rotated(x)
        asking = spark.sparkContext.broadcast(Queries(index, part.column("rep").to_numpy(), x, rotated, index.reach(rotated, probes)))
        found.append(staged(_best_rows(candidates.mapInArrow(_scan(dim, k + 1, asking), FOUND), k + 1), "best-vectors"))
        asking.unpersist()

    # the best k + 1 different vectors hold the best k rows; equal scores of different vectors all stay
    best = reduce(DataFrame.unionByName, found)
    hits = asked.join(best, "query").join(named, "candidate").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.select("query_id", "vec_id", "score").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
