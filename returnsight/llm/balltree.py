"""Ranked lexical search: exact inner products by best-first search of sparse ball trees.

A document is a sparse vector over the terms that the items ask for: a term's weight times its damped
frequency, an integer. An item is the 0/1 vector of its terms, so the inner product of the two is the
score. Each task deals its documents into shards and builds a ball tree of each: a node has a
centroid and, for each group of terms, the largest distance of its vectors from it within the group.
By the Cauchy-Schwarz inequality no vector of a node scores more than the item's product with the
centroid plus, for each group, the item's length within it times that radius; terms that the item
does not ask for thus widen a bound only by their own group. Bounds are rounded up by more than the
rounding of the floating-point sums can lose, so a subtree is dropped only if it cannot reach the
item's k-th best score so far; subtrees are opened in falling order of their bounds. Leaves are scored
in 64-bit integers.

Items are taken in blocks of at most ``BLOCK_TERMS`` (item, term) pairs, which bounds what is
broadcast and a node's width; a task keeps k answers an item, whatever the number of its shards."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from returnsight.llm.common import gathered, ready, staged

#: (item, term) pairs of a block; a larger item is a block of its own.
BLOCK_TERMS = 16_384
#: Documents of a shard, fewer where a block of one item is larger than that, and of a leaf.
SHARD, LEAF = 1024, 4
#: Groups of terms with radii of their own; half of them are single, the most frequent, terms.
GROUPS = 2048
#: Bounds are raised by this share, and squared distances by this share of the squares they come from.
RAISE = 1e-9

#: Terms are runs of letters, digits and non-ASCII characters; only A-Z are lower-cased.
SIGNS = bytes(b for b in range(128) if not chr(b).isalnum())
LOWER = bytes.maketrans(SIGNS + bytes(range(65, 91)), b" " * len(SIGNS) + bytes(range(97, 123)))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text. White space beyond ASCII belongs to terms, as bytes.split() leaves it."""
    return text.translate(LOWER).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Block(NamedTuple):
    """Items of a block and what their terms weigh; terms are numbered in the block."""

    item_ids: list[int | None]
    starts: np.ndarray  # of each item's terms
    terms: np.ndarray
    weights: np.ndarray  # of each term
    n_docs: int
    n_terms: int  # of all documents, with repeats
    k: int


class Rows(NamedTuple):
    """Sparse integer vectors by row."""

    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = self.starts[rows + 1] - self.starts[rows]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.starts[rows] - starts[:-1], size) + np.arange(starts[-1])
        return Rows(starts, self.terms[at], self.values[at])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


class BallTree(NamedTuple):
    centroids: np.ndarray  # nodes by terms
    radius: np.ndarray  # nodes by groups
    children: list[tuple[int, int] | None]  # None: a leaf
    leaves: dict[int, tuple[np.ndarray, Rows]]


def groups_of(weights: np.ndarray) -> np.ndarray:
    """Group number of each term: the most frequent ones alone, the rest dealt out."""
    rank = np.empty(len(weights), np.int64)
    rank[np.argsort(weights, kind="stable")] = np.arange(len(weights))
    half = GROUPS // 2
    return np.where(rank < half, rank, half + rank % half)


def build(rows: Rows, group: np.ndarray) -> BallTree:
    width, centroids, radius, children, leaves = len(group), [], [], [], {}
    todo = [(np.arange(len(rows.starts) - 1), rows, None)]
    while todo:
        members, own, above = todo.pop()
        node, n = len(radius), len(members)
        if above is not None:
            children[above] = (*(children[above] or ()), node)
        number, values = own.row_numbers(), own.values.astype(float)
        square = np.bincount(number, values * values, n)

        def distances(to: np.ndarray, square=square, number=number, values=values, own=own, n=n) -> np.ndarray:
            return square - 2 * np.bincount(number, values * to[own.terms], n) + float(to @ to)

        centre = np.bincount(own.terms, values, width) / n
        apart = distances(centre)
        centroids.append(centre)
        radius.append(_radii(own, number, values, centre, group))
        children.append(None)
        halves = None if n <= LEAF else _halves(own, distances, int(np.argmax(apart)), width)
        if halves is None:
            leaves[node] = (members, own)
        else:
            todo += [(members[half], own.take(half), node) for half in halves]
    return BallTree(np.array(centroids), np.array(radius), children, leaves)


def _radii(rows: Rows, number: np.ndarray, values: np.ndarray, centre: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Largest distance of a row from the centre within each group, rounded up."""
    n = len(rows.starts) - 1
    cell = number * GROUPS + group[rows.terms]
    own = np.bincount(group, centre * centre, GROUPS)
    less = np.bincount(cell, values * (values - 2 * centre[rows.terms]), n * GROUPS).reshape(n, GROUPS).max(axis=0)
    size = np.bincount(cell, values * values, n * GROUPS).reshape(n, GROUPS).max(axis=0)
    return np.sqrt(np.maximum(0.0, own + less) + RAISE * (own + size))


def _halves(rows: Rows, distances, far: int, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows nearer to one of two distant rows than to the other, in halves where this is lopsided;
    None if all rows are equal."""

    def dense(row: int) -> np.ndarray:
        out, span = np.zeros(width), slice(rows.starts[row], rows.starts[row + 1])
        out[rows.terms[span]] = rows.values[span]
        return out

    first = distances(dense(far))
    other = int(np.argmax(first))
    if first[other] <= 0.5:  # integer vectors, so their squared distance is 0 or at least 1
        return None
    lean = first - distances(dense(other))
    nearer = lean <= 0
    if not 0.1 <= nearer.mean() <= 0.9:
        order = np.argsort(lean, kind="stable")
        return order[: len(order) // 2], order[len(order) // 2 :]
    return np.flatnonzero(nearer), np.flatnonzero(~nearer)


class Best(NamedTuple):
    """An item's best documents: scores, whether the id is missing, ids; highest first."""

    score: np.ndarray
    missing: np.ndarray
    doc_id: np.ndarray

    def merged(self, score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray, k: int) -> Best:
        s, m, d = (np.concatenate(c) for c in zip(self, (score, missing, doc_id), strict=True))
        top = np.lexsort((d, m, -s))[:k]
        return Best(s[top], m[top], d[top])


NONE = Best(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))


def search(tree: BallTree, missing: np.ndarray, doc_ids: np.ndarray, block: Block, best: list[Best]) -> int:
    """Bring each item's ``best`` up to date with the tree's documents; the number of leaves scored."""
    size, scored, group = np.diff(block.starts), 0, groups_of(block.weights)
    pairs, asked = np.unique(np.repeat(np.arange(len(size)), size) * GROUPS + group[block.terms], return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(size)) * GROUPS)
    reach = np.add.reduceat(tree.radius[:, pairs % GROUPS] * np.sqrt(asked), first, axis=1)
    bounds = (np.add.reduceat(tree.centroids[:, block.terms], block.starts[:-1], axis=1) + reach) * (1 + RAISE)
    wanted = np.zeros(len(block.weights), bool)
    for item in range(len(block.item_ids)):
        wanted[:] = False
        wanted[block.terms[block.starts[item] : block.starts[item + 1]]] = True
        bound, open_nodes = bounds[:, item], [(-bounds[0, item], 0)]
        while open_nodes:
            top, node = heapq.heappop(open_nodes)
            enough = best[item].score[-1] if len(best[item].score) == block.k else 1
            if -top < enough:
                break
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    if bound[child] >= enough:
                        heapq.heappush(open_nodes, (-bound[child], child))
                continue
            members, rows = tree.leaves[node]
            sums = np.concatenate([[0], np.cumsum(np.where(wanted[rows.terms], rows.values, 0))])
            score = sums[rows.starts[1:]] - sums[rows.starts[:-1]]
            good = score >= enough
            if good.any():
                chosen = members[good]
                best[item] = best[item].merged(score[good], missing[chosen], doc_ids[chosen], block.k)
            scored += 1
    return scored


def vectors(block: Block, lengths: list[int], starts: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> Rows:
    """Weighted damped frequencies: weight * (10^9 tf div (1000 tf + 8 m)), m by document length."""
    m = np.array([10 + 90 * n * block.n_docs // block.n_terms for n in lengths], np.int64)
    tf = tf.astype(np.int64)
    return Rows(starts, terms, block.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(starts)))))


def _counted(shared):
    """Tasks over (doc_id, text): term count of each document, and the counts of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in gathered(batches, 1):
            lengths, starts, terms, counts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(text)
                tf = Counter(map(number.get, found))
                tf.pop(None, None)
                lengths.append(len(found))
                terms += tf.keys()
                counts += tf.values()
                starts.append(len(terms))
            at = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(c, pa.int32())) for c in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in batches:
        for lo in range(0, len(batch), size):
            held.append(batch.slice(lo, size))
            rows += len(held[-1])
            if rows >= size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


FOUND = "item int, doc_id long, score long"


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = [NONE] * len(block.item_ids)
        size = max(2 * LEAF, min(SHARD, SHARD * BLOCK_TERMS // len(block.terms)))  # a tree's nodes are this wide
        for shard in _shards(batches, size):
            ids = shard.column(0)
            missing, doc_ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            starts = np.concatenate([[0], np.cumsum(np.diff(shard.column(2).offsets.to_numpy()))])
            terms, tf = (shard.column(c).flatten().to_numpy() for c in (2, 3))
            rows = vectors(block, shard.column(1).to_pylist(), starts, terms, tf)
            search(build(rows, groups_of(block.weights)), missing, doc_ids, block, best)
        item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.score) for b in best])
        ids = pa.array(np.concatenate([b.doc_id for b in best]), mask=np.concatenate([b.missing for b in best]))
        yield pa.RecordBatch.from_arrays([pa.array(item), ids, pa.array(np.concatenate([b.score for b in best]))], ["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(set(terms_of(text))) for text in batch.column(1).cast(pa.binary()).to_pylist()]
        item = pa.array(np.repeat(np.arange(len(batch)), [len(t) for t in found]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(item), pa.array([t for row in found for t in row], pa.binary())], ["item_id", "term"])


def _blocks(asked: DataFrame, limit: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, in blocks of at most ``limit`` pairs or one item."""
    sizes = asked.groupBy("item_id").agg(F.count("*").alias("n")).orderBy("item_id")
    held, pairs = [], 0
    for row in sizes.toLocalIterator():  # two numbers an item; only the current block is kept
        if held and pairs + row["n"] > limit:
            yield _items(asked, held)
            held, pairs = [], 0
        held.append(row["item_id"])
        pairs += row["n"]
    if held:
        yield _items(asked, held)


def _items(asked: DataFrame, ids: list[int | None]) -> list[tuple[int | None, list[bytes]]]:
    known = [i for i in ids if i is not None]
    here = F.col("item_id").isNull() if None in ids else F.lit(False)
    if known:  # blocks follow the order of the ids
        here = here | F.col("item_id").between(min(known), max(known))
    terms: dict = {i: [] for i in ids}
    for row in asked.where(here).collect():
        terms[row["item_id"]].append(bytes(row["term"]))
    return list(terms.items())


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``k`` rows of ``docs`` with the highest scores above 0 for each item of ``items``: item_id,
    rank (from 1), doc_id, score; equal scores by ascending doc_id, rows without one last.

    Every row of ``docs`` is a document of its own, repeated ids included; a null or empty text has
    no terms. Rows of ``items`` that share an item_id (null too) are one item with the terms of all.
    Items without terms, and documents without any of an item's terms, give no rows, nor do empty
    tables. Other columns are ignored."""
    spark = ready(docs).sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    asked = staged(asked.mapInArrow(_item_terms, "item_id long, term binary").distinct(), "item-terms")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    answers = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    answers += [_answers(texts, block, k) for block in _blocks(asked, block_terms)]
    return reduce(DataFrame.unionByName, answers[1:] or answers)


def _answers(texts: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    spark = texts.sparkSession
    number = {term: i for i, term in enumerate(sorted({t for _, terms in items for t in terms}))}
    shared = spark.sparkContext.broadcast(number)
    counted = staged(texts.mapInArrow(_counted(shared), "doc_id long, n long, terms array<int>, tf array<int>"), "counted")
    shared.unpersist()
    total = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = dict.fromkeys(range(len(number)), 0) | {r["term"]: r["count"] for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([weight(total["docs"], df[t]) for t in range(len(number))], np.int64)
    starts = np.concatenate([[0], np.cumsum([len(terms) for _, terms in items])])
    terms = np.array([number[t] for _, own in items for t in own], np.int64)
    block = spark.sparkContext.broadcast(Block([i for i, _ in items], starts, terms, weights, total["docs"], total["terms"], k))
    found = counted.where(F.size("terms") > 0).mapInArrow(_searched(block), FOUND)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    best = staged(found.withColumn("rank", rank).where(F.col("rank") <= k), "ranked")
    block.unpersist()
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(items)], "number int, item_id long")
    return best.join(F.broadcast(names), F.col("item") == F.col("number")).select("item_id", "rank", "doc_id", "score")
