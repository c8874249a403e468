"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints link at ``max_bits`` or fewer differing bits, so of ``max_bits + 1`` blocks of their
bits one is equal. For each block there is a trie whose paths begin with it: no error is allowed on
the block, ``max_bits`` on the rest. The block's value deals the fingerprints out to tasks; a task
walks its tries from the roots, pairs of nodes together, adds up the bits in which they differ and
drops a pair once that exceeds the budget, or once all under both nodes is already one component.

A value that many fingerprints share is split before dealing: of the bits not yet fixed, again one
of ``max_bits + 1`` blocks is equal. That is exact at any depth and no pair is left out. Exact
copies count once from the start, so a large group of copies is a single leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm.common import ready, slices, staged
from returnsight.llm.components import components, forest

#: Node pairs that a task expands at a time.
FRONTIER = 1 << 19
#: Fingerprints of whole groups that a task walks together.
GROUPED = 1 << 16


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero without words."""
    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest, bits, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), n
    for lo in range(0, n, 1 << 16):
        some = [digest(line[a:b], 42) for a, b in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)], strict=True)]
        flat = np.unpackbits(np.array(some, ">u8").view(np.uint8)).reshape(-1, 64)
        bits += flat.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * bits > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long. Null text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in slices([len(t or "") for t in texts.to_pylist()]):
                fps = [fingerprint(t, words) for t in texts[lo:hi].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


class Tries:
    """The tries of several groups over sorted arrays; a node at depth d is a run of elements of one
    group whose first d bits agree."""

    def __init__(self, group: np.ndarray, bits: np.ndarray):
        """Sorted by group, then bits (uint64, most significant bit first); no equal elements."""
        self.bits, n = bits, len(bits)
        differ = bits[1:] ^ bits[:-1]
        shared = np.full(n, -1, np.int8)  # leading bits shared with the element before
        shared[1:] = 64
        for step in (32, 16, 8, 4, 2, 1):  # the position of the highest differing bit by halving
            high = differ >> np.uint64(step)
            big = high > 0
            differ = np.where(big, high, differ)
            shared[1:] -= (big * step).astype(np.int8)
        shared[1:] -= (differ > 0).astype(np.int8)
        shared[1:][group[1:] != group[:-1]] = -1
        self.shared = shared
        self.cache: dict[int, np.ndarray] = {}

    def starts(self, depth: int) -> np.ndarray:
        """First element of every node at ``depth``, and the end."""
        if depth not in self.cache:
            self.cache[depth] = np.append(np.flatnonzero(self.shared < depth), len(self.bits)).astype(np.int64)
        return self.cache[depth]

    def components(self, budget: int, frontier: int = FRONTIER) -> np.ndarray:
        """Smallest linked element of every element, by walking pairs of nodes from the roots."""
        n = len(self.bits)
        labels = np.arange(n)
        roots = np.arange(len(self.starts(0)) - 1)
        stack = [(0, roots, roots, np.zeros(len(roots), np.int8))]
        while stack:
            depth, a, b, err = stack.pop()
            if len(a) > frontier:
                order = np.argsort(-err, kind="stable")  # pairs with fewer errors are taken first
                stack += [(depth, a[k], b[k], err[k]) for k in np.array_split(order, -(-len(a) // frontier))]
                continue
            here = self.starts(depth)
            if len(a) > frontier // 16:
                low = np.minimum.reduceat(labels, here[:-1])
                one = low == np.maximum.reduceat(labels, here[:-1])
                open_ = ~(one[a] & one[b] & (low[a] == low[b]))
                a, b, err = a[open_], b[open_], err[open_]
            size = np.diff(here)
            single = (size[a] == 1) & (size[b] == 1)
            x, y = here[a[single]], here[b[single]]
            near = (x != y) & (np.bitwise_count(self.bits[x] ^ self.bits[y]) <= budget)
            forest(n, x[near], y[near], labels)
            a, b, err = a[~single], b[~single], err[~single]
            if depth == 64 or not len(a):
                continue
            below = self.starts(depth + 1)
            child = np.searchsorted(below, here)  # first child of every node
            bit = (self.bits[below[:-1]] >> np.uint64(63 - depth)) & np.uint64(1)
            found = []
            for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
                ca, cb = child[a] + i, child[b] + j
                real = (ca < child[a + 1]) & (cb < child[b + 1])
                if i > j:
                    real &= a != b
                ca, cb = ca[real], cb[real]
                e = err[real] + (bit[ca] != bit[cb]).astype(np.int8)
                kept = e <= budget
                found.append((ca[kept], cb[kept], e[kept]))
            a, b, err = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(a):
                stack.append((depth + 1, a, b, err))
        return labels


def group_links(group: np.ndarray, fp: np.ndarray, bits: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what each group's links connect: (fingerprint, another of its component).
    ``bits``: the fingerprint, its bits in the group's own order."""
    bits = bits.view(np.uint64)
    order = np.lexsort((bits, group))
    labels = Tries(group[order], bits[order]).components(budget)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    own = fp[order]
    return own[moved], own[labels[moved]]


def _links(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                rows += batch.num_rows
            if not rows or (batch is not None and rows < GROUPED):
                continue
            key, fp, bits = (np.concatenate(c) for c in zip(*held, strict=True))
            # the last key may go on in the next batch
            cut = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
            if cut:
                a, b = group_links(key[:cut], fp[:cut], bits[:cut], budget)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held, rows = [[key[cut:], fp[cut:], bits[cut:]]], len(key) - cut

    return run


def _turned(bits: Column, free: int, by: int) -> Column:
    """``bits`` with its last ``free`` bits rotated left."""
    mask = (1 << free) - 1 if free < 64 else -1
    low = bits.bitwiseAND(F.lit(mask))
    turn = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, free - by)).bitwiseAND(F.lit(mask))
    return bits.bitwiseAND(F.lit(~mask)).bitwiseOR(turn) if by else bits


def _split(rows: DataFrame, free: int, parts: int) -> DataFrame:
    """Rows (key, fp, bits) once for each of ``parts`` equal blocks of the last ``free`` bits: the
    block comes first among them, and its value becomes part of the key."""
    width, used = free // parts, 64 - free
    copies = []
    for k in range(parts):
        bits = _turned(F.col("bits"), free, k * width)
        value = F.shiftrightunsigned(F.shiftleft(bits, used), 64 - width)
        copies.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), bits.alias("bits")))
    return rows.select("fp", F.explode(F.array(*copies)).alias("to")).select("to.key", "fp", "to.bits")


def linked_fingerprints(fps: DataFrame, max_bits: int, hot: int = 4096, levels: int = 3) -> DataFrame:
    """(a, b): links that connect all of ``fps`` (distinct fp long) that ``max_bits`` or fewer bits
    connect. Values shared by more than ``hot`` are split again, up to ``levels`` times in all; what
    is shared beyond that is walked whole. Keys are hashes: a clash adds work, never a link."""
    parts, free = max_bits + 1, 64
    rows = ready(fps).select(F.lit(0).cast("long").alias("key"), "fp", F.col("fp").alias("bits"))
    links = None
    for level in range(levels):
        rows = _split(rows, free, parts)
        free -= free // parts
        whole, rest = rows, None
        if level + 1 < levels and free >= 2 * parts:
            rows = staged(rows, "trie-rows")
            full = staged(rows.groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-keys")
            if not full.isEmpty():
                whole, rest = rows.join(full, "key", "left_anti"), rows.join(full, "key", "left_semi")
            else:
                whole = rows
        dealt = whole.repartition("key").sortWithinPartitions("key").mapInArrow(_links(max_bits), "a long, b long")
        links = dealt if links is None else links.unionByName(dealt)
        if rest is None:
            break
        rows = rest
    return links


def rooted_fingerprints(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), root (the fingerprint that names the
    component) and component_id, as in ``simhash_groups``."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(linked_fingerprints(classes.select("fp"), max_bits))
    rooted = staged(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    # written first: both sides of the join are then plain shuffles, whose hot partitions AQE splits
    smallest = staged(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    of_fp = staged(rooted.join(smallest, "root").select(F.col("fp").alias("of"), "root", "component_id"), "fingerprint-components")
    return rows.join(of_fp, F.col("fp") == F.col("of")).select("doc_id", "fp", "root", "component_id")


def fingerprint_of(text: Column, words: int = 4) -> Column:
    """Fingerprint of a text as a signed long (null: empty)."""

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return run(text.cast("string"))


def simhash_groups(docs: DataFrame, words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id that links of ``max_bits`` or fewer differing bits reach.

    Null texts count as empty; texts without words have fingerprint zero and link like any other;
    rows with equal ids stay; rows with a null id get the smallest id that is not null (null if the
    component has none). An empty table gives no rows; other columns are ignored."""
    out = rooted_fingerprints(docs, words, max_bits)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
