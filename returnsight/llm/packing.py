"""Best-fit packing of tokenised documents into sequences of fixed length.

A document's ids (end id included) are cut into full pieces and a rest; a full piece is a sequence
of its own. The packing of the rests depends only on how many there are of each length, a table of
at most ``capacity`` rows whatever the corpus, so the whole corpus is packed at once:

* rests above a third of the capacity, at most two of which fit together, are matched greedily:
  the longest with the longest partner that still fits;
* shorter rests, longest first, go to the smallest gap that holds them, item by item.

Both walk the lengths, not the items; what they decide for a length is a few runs ("the next 500 of
this length go to sequences 1200 to 1449, two each"). Every piece has a rank among those of its
length, numbered inside its partition and shifted by the counts of the partitions before, and its
run gives it a sequence and an offset. No task or driver ever holds more than lengths and runs.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm.common import gathered, ready, staged
from returnsight.llm.tokens import LibraryChunks, sliced_ids, worker_table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class Run(NamedTuple):
    """Pieces of ``length`` ranked ``rank`` and on, ``each`` to a sequence from ``sequence`` on, at
    ``offset`` and behind one another."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


class _Plan:
    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[Run] = []
        self.placed: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)
        self.sizes: list[int] = []  # gaps with sequences, rising

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        rank = self.placed.get(length, 0)
        self.runs.append(Run(length, rank, sequence, each, offset))
        self.placed[length] = rank + n

    def leave(self, gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in self.gaps:
                self.gaps[gap] = []
                bisect.insort(self.sizes, gap)
            self.gaps[gap].append((sequence, n))

    def match(self, counts: dict[int, int]) -> None:
        """Lengths above a third: pairs of the longest and its longest fitting partner."""
        left = dict(counts)
        rising = sorted(left)
        while rising:
            long = rising[-1]
            k = bisect.bisect_right(rising, self.capacity - long) - 1
            if k < 0 or (rising[k] == long and left[long] < 2):
                k = k - 1 if k >= 0 else k
            if k < 0:
                n = left[long]
                first = self.open(n)
                self.put(long, n, first, 1, 0)
                self.leave(self.capacity - long, first, n)
                left[long] = 0
            else:
                partner = rising[k]
                n = left[long] // 2 if partner == long else min(left[long], left[partner])
                first = self.open(n)
                self.put(long, n, first, 1, 0)
                self.put(partner, n, first, 1, long)
                self.leave(self.capacity - long - partner, first, n)
                left[long] -= n
                left[partner] -= n
                if partner != long and not left[partner]:
                    rising.pop(k)
            if not left[long]:
                rising.pop()

    def fill(self, counts: dict[int, int]) -> None:
        """Lengths up to a third, longest first: the smallest gap that holds the item."""
        for length in sorted(counts, reverse=True):
            n = counts[length]
            while n:
                k = bisect.bisect_left(self.sizes, length)
                if k < len(self.sizes):
                    gap = self.sizes[k]
                    first, have = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        del self.gaps[gap]
                        self.sizes.pop(k)
                    each = gap // length
                    whole = min(have, n // each)
                    rest = 0 if whole == have else n - whole * each
                    self.leave(gap, first + whole + (rest > 0), have - whole - (rest > 0))
                else:
                    gap, each = self.capacity, self.capacity // length
                    whole, rest = divmod(n, each)
                    first = self.open(whole + (rest > 0))
                if whole:
                    self.put(length, whole * each, first, each, self.capacity - gap)
                    self.leave(gap - each * length, first, whole)
                if rest:
                    self.put(length, rest, first + whole, each, self.capacity - gap)
                    self.leave(gap - rest * length, first + whole, 1)
                n -= whole * each + rest


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Runs that pack ``counts[length]`` pieces of each length (1 to ``capacity``)."""
    p = _Plan(capacity)
    if n := counts.get(capacity, 0):
        p.put(capacity, n, p.open(n), 1, 0)
    p.match({k: v for k, v in counts.items() if v and k < capacity < 3 * k})
    p.fill({k: v for k, v in counts.items() if v and 3 * k <= capacity})
    return sorted(p.runs)


def tokenised_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the partition that made it and its rank there among its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = worker_table(LibraryChunks, vocabulary)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches, text=1):
            doc_ids = batch.column(0).to_pylist()
            for lo, ids, ends in sliced_ids(encoder, batch.column(1), end_id):
                ids, ends = ids.astype("<u4", copy=False), ends.tolist()
                rows = []
                for k in range(len(ends) - 1):
                    for piece, at in enumerate(range(ends[k], ends[k + 1], capacity)):
                        n = min(capacity, ends[k + 1] - at)
                        rows.append((doc_ids[lo + k], piece, piece * capacity, n, zlib.crc32(ids[at : at + n]), part, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    rows = ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith("int") else pa.int64()) for c in PIECES.split(", ")])


def place(runs: list[Run]) -> Column:
    """(sequence_id, offset) of a piece from its length and rank. ``runs`` is bounded by the number
    of lengths, not by the rows."""
    table = np.array(runs or [(0, 0, 0, 1, 0)], np.int64)
    keys = (table[:, 0] << 48) + table[:, 1]

    @pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy(), rank.to_numpy()
        run = table[np.searchsorted(keys, (size << 48) + rank, side="right") - 1]
        at = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + at // run[:, 3], "offset": run[:, 4] + at % run[:, 3] * size})

    return placed("length", "rank")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts give one piece, the end id; texts of any length are cut, never dropped; rows with equal or
    null ids are all packed; an empty table gives no rows; other columns are ignored."""
    pieces = staged(tokenised_pieces(docs, vocabulary, capacity, end_id), "pieces")
    counts = staged(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.col("part").alias("of_part"), F.col("length").alias("of_length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    same = (F.col("part") == F.col("of_part")) & (F.col("length") == F.col("of_length"))
    # the table of shifts grows with the partitions, so it is never broadcast, small as its files are
    ranked = pieces.join(shifts.hint("merge"), same).withColumn("rank", F.col("rank") + F.col("shift"))
    return ranked.withColumn("at", place(plan(totals, capacity))).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
