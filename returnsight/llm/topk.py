"""Exact top-k inner products by no-random-access aggregation over sorted lists.

A task takes candidates in segments and keeps, for every dimension, a list of their components in
ascending order. A query component's sign says from which end its list is read, so each list gives
contributions in falling order. All lists are read down to a common contribution, level by level. A
candidate's known contributions, with the list ends in place of the rest, bound its score from
below; with the level reached in place of the rest, from above. Reading ends when all but a few
candidates have an upper bound under the k-th best lower bound or under the k-th best score of
earlier segments. Only those few are scored in full, in integers.

Queries are broadcast in chunks of at most ``CHUNK_BYTES``, each against all candidates; a task keeps
k answers a query, whatever the number of its segments."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from returnsight.llm.common import chunked, ready, staged
from returnsight.llm.vectors import doubles

#: Candidates that a task reads together: of the first segment, which gives a first bound, and later.
FIRST, SEGMENT = 512, 8192
#: Bytes of query components that are broadcast at once.
CHUNK_BYTES = 32 << 20
#: Reading goes on while more than this share of a segment could still qualify.
LEFT = 1 / 64
#: Levels of a list, as multiples of a contribution's mean size.
STEP, LEVELS = 0.6, 8
LONG = np.iinfo(np.int64)

FOUND = "query_id long, vec_id long, score long"


def finite(vector: Column) -> Column:
    """Whether a vector is not null and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * c) of every component, as longs."""
    return F.transform(vector, lambda c: F.floor(c * F.lit(float(scale))))


class Lists(NamedTuple):
    ids: np.ndarray
    x: np.ndarray  # candidates by dimensions, integers
    rows: np.ndarray  # dimensions by positions: candidates in ascending order of their component
    values: np.ndarray  # these components
    size: np.ndarray  # mean absolute component of each dimension


def sorted_lists(ids: np.ndarray, x: np.ndarray) -> Lists:
    rows = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
    return Lists(ids, x, rows, np.take_along_axis(x.T, rows, axis=1), np.abs(x.astype(float)).mean(axis=0))


def exact_scores(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond a long are the nearest long."""
    if float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(query.astype(float)).sum()) < 2.0**62:
        return x @ query
    return np.clip(x.astype(object) @ query.astype(object), LONG.min, LONG.max).astype(np.int64)


def qualifying(lists: Lists, query_id: int, query: np.ndarray, k: int, bound: float) -> np.ndarray:
    """Rows of candidates that can be among the k best or reach ``bound``, after reading the sorted
    lists from their high ends as far as needed."""
    n = len(lists.ids)
    others = lists.ids != query_id
    used = np.flatnonzero(query)
    if n <= k or not len(used):
        return np.flatnonzero(others)
    weight = query[used].astype(float)
    ends = np.where(weight > 0, lists.values[used, 0], lists.values[used, -1]) * weight  # least contributions
    tops = np.where(weight > 0, lists.values[used, -1], lists.values[used, 0]) * weight
    total = float(np.maximum(np.abs(ends), np.abs(tops)).sum())
    slack = 0.0 if total < 2.0**53 else total * len(used) * 2.0**-50  # sums of integers are exact below
    step = max(1.0, STEP * float(np.abs(weight) @ lists.size[used]) / len(used))
    start = min(bound / len(used), float(tops.max())) if math.isfinite(bound) else float(tops.max()) - step
    levels = [int(start - j * step) for j in range(LEVELS) if start - j * step > ends.min()] + [int(ends.min())]
    reach = _reach(lists.values, used, query, levels)
    # a bound from earlier segments is a k-th best score, no lower than this segment's lower bounds
    known, seen, floors = np.zeros(n), np.zeros(n, int), None if math.isfinite(bound) else np.full(n, ends.sum())
    before = np.where(weight > 0, n, 0)
    for j, level in enumerate(levels):
        here = reach[:, j] if j < len(levels) - 1 else np.where(weight > 0, 0, n)
        parts = [(d, slice(min(a, b), max(a, b))) for d, a, b in zip(used.tolist(), before.tolist(), here.tolist(), strict=True)]
        before = here
        at = np.concatenate([lists.rows[d, part] for d, part in parts])
        gained = np.concatenate([lists.values[d, part] * w for (d, part), w in zip(parts, weight.tolist(), strict=True)])
        known += np.bincount(at, gained, n)
        seen += np.bincount(at, minlength=n)
        upper = known + (len(used) - seen) * level + slack
        least = bound
        if floors is not None:
            floors += np.bincount(at, gained - np.repeat(ends, [part.stop - part.start for _, part in parts]), n)
            if np.count_nonzero(others) >= k:
                least = np.partition(floors[others], -k)[-k]
        alive = others & (upper >= least - slack)
        if np.count_nonzero(alive) <= max(2 * k, n * LEFT):
            break
    return np.flatnonzero(alive)


def _reach(values: np.ndarray, used: np.ndarray, query: np.ndarray, levels: list[int]) -> np.ndarray:
    """Positions up to which each used list holds contributions of every level or more: from its end
    for positive query components, from its start for negative ones. Integer division keeps an entry
    that is exactly on the level."""
    out = np.empty((len(used), len(levels)), np.int64)
    for row, d in enumerate(used.tolist()):
        w = int(query[d])
        least = [min(max(-(-level // w) if w > 0 else level // w, LONG.min), LONG.max) for level in levels]
        out[row] = np.searchsorted(values[d], np.array(least, np.int64), side="left" if w > 0 else "right")
    return out


def _segments(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows, held, limit = [], [], 0, FIRST
    for batch in batches:
        known, x = batch.column(0).to_numpy(), long_matrix(batch.column(1), dim)
        for lo in range(0, len(known), SEGMENT):
            ids.append(known[lo : lo + SEGMENT])
            rows.append(x[lo : lo + SEGMENT])
            held += len(ids[-1])
            if held >= limit:
                yield np.concatenate(ids), np.concatenate(rows)
                ids, rows, held, limit = [], [], 0, SEGMENT
    if held:
        yield np.concatenate(ids), np.concatenate(rows)


def long_matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array of longs, padded with zeros to ``dim``."""
    size = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, int)
    if (size == dim).all():
        return vectors.flatten().to_numpy().reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    for row, values in enumerate(vectors.to_pylist()):
        out[row, : len(values)] = values
    return out


def _scan(dim: int, k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(query_ids)
        for ids, x in _segments(batches, dim):
            lists = sorted_lists(ids, x)
            for q, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
                bound = float(scores[q][-1]) if len(scores[q]) == k else -np.inf
                rows = qualifying(lists, query_id, query, k, bound)
                score = np.concatenate([scores[q], exact_scores(x[rows], query)])
                names = np.concatenate([found[q], ids[rows]])
                best = np.lexsort((names, ~score))[:k]  # ~ falls as the score rises, and every long has it
                scores[q], found[q] = score[best], names[best]
        if len(query_ids):
            asked = np.repeat(query_ids, [len(s) for s in scores])
            columns = [asked, np.concatenate(found), np.concatenate(scores)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return run


def top_products(rows: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ``k`` rows with the highest integer inner product for each row whose vec_id ``every``
    divides: query_id, rank (from 1), vec_id, score; ties go to the smaller id.

    Components count as floor(scale * c). Rows whose id is null, or whose vector is null or holds a
    null or non-finite component, take no part; zero and empty vectors do, and shorter vectors count
    as padded with zeros. A query finds no row of its own id. Repeated rows are candidates one by
    one. Query rows equal in id and vector ask once; those of one id with different vectors are
    ranked together. With fewer candidates all are found; an empty table gives no rows. Scores beyond
    a long are given, and ranked, as the nearest long. Other columns are ignored."""
    spark = ready(rows).sparkSession
    vector = doubles(F.col("embedding"))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.col("vec_id").isNotNull() & finite(F.col("vector")))
    own = staged(own.select("vec_id", scaled(F.col("vector"), scale).alias("x")), "scaled")
    size = own.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    asking = staged(own.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), "queries")
    limit = max(1, chunk_bytes // (8 * dim))
    chunk, chunks = chunked(asking, ["vec_id", "x"], limit)
    # a task for every core, or for every 64 segments; few rows make fewer tasks
    cores = spark.sparkContext.defaultParallelism
    candidates = own.repartition(max(1, min(max(cores, math.ceil(n / (64 * SEGMENT))), math.ceil(n / FIRST))))
    answers = None
    for j in range(chunks):
        part = asking.where(chunk == j).toArrow().combine_chunks()
        x = long_matrix(part.column("x").combine_chunks(), dim)
        shared = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), x))
        found = staged(_best(candidates.mapInArrow(_scan(dim, k, shared), FOUND), k).drop("rank"), "found")
        shared.unpersist()
        answers = found if answers is None else answers.unionByName(found)
    return _best(answers, k).select("query_id", "rank", "vec_id", "score")


def _best(answers: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k)
