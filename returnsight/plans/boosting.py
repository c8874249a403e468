"""Boosted trees of all folds and data sets at once.

Every row trains the models of its data set whose fold is not its own. One pass over the rows gives,
for a level of all models' trees, the count, sum and sum of squares of the residuals by node,
predictor and bin; the sums of a model meet in one task, which picks its splits, so the driver gets a
few numbers a node. Rows stay in their partitions, in bins and with their margins under every model.

The trees are those of Spark's ``GBTClassifier`` on the same rows: squared-error trees on the gradient
of the log-loss, the first of weight 1, the first of equal gains. Its thresholds are used too: halfway
between the distinct values or, where these are more than the bins, between bins of about equal
counts; frames of more than ``max(bins ** 2, 10000)`` rows give about that many, drawn at random, for
the thresholds alone. What is held besides the rows grows with models x nodes x bins."""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.functions import nan_to_null, ship_by_value
from returnsight.operators.features import broadcast_if_small

ship_by_value(__name__)

#: Rows to a partition, up to a partition per core, and to a block inside of it.
PARTITION_ROWS = BLOCK_ROWS = 25_000
#: Models whose splits one task picks.
TASK_MODELS = 10
#: Rows that thresholds are taken from at least, as in Spark ML.
THRESHOLD_ROWS = 10_000
#: Impurity under which a node is not split.
PURE = 2.0**-52


@dataclass(frozen=True)
class Design:
    """What turns rows into bins; models are numbered data set x folds + fold."""

    n_folds: int
    cols: list[str]
    ordered: list[str]
    fill: np.ndarray  # models x columns: stands for a missing value; columns in order have none
    most: np.ndarray  # models: thresholds at most
    thresholds: dict[tuple[int, int], np.ndarray]  # (model, column)

    @property
    def bins(self) -> int:
        return 1 + max((len(t) for t in self.thresholds.values()), default=0)

    def values(self, x: np.ndarray, model: int, column: int) -> np.ndarray:
        return np.where(np.isnan(x), self.fill[model, column], x)


def fold_places(sums: DataFrame, orders: DataFrame, column: str, n_folds: int) -> DataFrame:
    """``(_dataset, _code, <column>_0, <column>_1, ...)``: the places of each category of a data set in
    the orders of its folds' training rows; where these lack it, the place of unseen codes."""
    order = orders.filter(F.col("column_name") == column)
    known = order.select(F.col("dataset").alias("_d"), F.col("fold").alias("_f"), F.col("code").alias("_c"), F.col("place").cast("double").alias("_place"))
    unseen = order.groupBy("dataset", "fold").agg(F.max("unseen").alias("unseen"))  # a row per data set and fold
    codes = sums.filter(F.col("column_name") == column).select("dataset", "code").distinct()
    codes = codes.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).join(F.broadcast(unseen), ["dataset", "fold"])
    same = (F.col("dataset") == F.col("_d")) & (F.col("fold") == F.col("_f")) & F.col("code").eqNullSafe(F.col("_c"))
    place = F.coalesce("_place", "unseen")
    by_fold = [F.max(F.when(F.col("fold") == k, place)).alias(f"{column}_{k}") for k in range(n_folds)]
    return codes.join(known, same, "left").groupBy(F.col("dataset").alias("_dataset"), F.col("code").alias("_code")).agg(*by_fold)


def _training(rows: DataFrame, cols: Sequence[str], ordered: Sequence[str], n_sets: int, n_folds: int) -> tuple[np.ndarray, np.ndarray]:
    """Per model its training rows and the values that stand for missing ones, as
    ``models.missing_values`` has them, in one aggregation."""
    wrong = F.count_if(F.col("label").isNull() | ~F.col("label").isin(0.0, 1.0))
    numeric = [i for i, c in enumerate(cols) if c not in ordered]
    found = rows.groupBy("dataset", "fold").agg(
        F.count(F.lit(1)).alias("n"), wrong.alias("wrong"),
        *[f(nan_to_null(F.col(cols[i]).cast("double"))).alias(f"{f.__name__}{i}") for i in numeric for f in (F.min, F.max)],
    ).collect()  # a row per data set and fold
    if any(r["wrong"] for r in found):
        raise ValueError("labels must be 0 or 1")
    n, low, high = np.zeros((n_sets, n_folds)), np.full((n_sets, n_folds, len(cols)), np.inf), np.full((n_sets, n_folds, len(cols)), -np.inf)
    for r in found:
        n[r["dataset"], r["fold"]] = r["n"]
        for i in numeric:
            if r[f"min{i}"] is not None:
                low[r["dataset"], r["fold"], i], high[r["dataset"], r["fold"], i] = r[f"min{i}"], r[f"max{i}"]
    fill = np.zeros((n_sets * n_folds, len(cols)))
    for m in range(n_sets * n_folds):
        others = np.arange(n_folds) != m % n_folds
        lo, hi = low[m // n_folds, others].min(axis=0), high[m // n_folds, others].max(axis=0)
        for i in numeric:
            if lo[i] <= hi[i]:
                fill[m, i] = lo[i] - max(1.0, hi[i] - lo[i])
    return (n.sum(axis=1, keepdims=True) - n).ravel(), fill


def thresholds_between(values: np.ndarray, most: int) -> np.ndarray:
    """Halfway between the distinct values, or at most some ``most`` of these places, where the counts
    of the values up to there are nearest to equal shares."""
    v, n = np.unique(values, return_counts=True)
    between = (v[:-1] + v[1:]) / 2
    if len(between) <= most:
        return between
    up_to = np.cumsum(n)
    halves, share = (up_to[:-1] + up_to[1:]) / 2, len(values) / (most + 1)
    picked, at, target = [], 0, share
    while (at := max(at, int(np.searchsorted(halves, target, side="right")))) < len(halves):
        picked.append(between[at])
        at, target = at + 1, target + share
    return np.array(picked)


def _column_thresholds(design: Design):
    """Groups of one data set and column: the thresholds of each fold's training rows."""

    def run(key, table):
        dataset, column = (k.as_py() for k in key)
        fold = table.column("fold").to_numpy()
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(fold), -1)
        found = []
        for k in range(design.n_folds):
            m = dataset * design.n_folds + k
            own = values[fold != k, min(k, values.shape[1] - 1)]
            found.append(thresholds_between(design.values(own, m, column), int(design.most[m])))
        return pa.table({
            "model": pa.array(dataset * design.n_folds + np.arange(design.n_folds), pa.int32()),
            "column": pa.array([column] * design.n_folds, pa.int32()),
            "thresholds": pa.array([t.tolist() for t in found], pa.list_(pa.float64())),
        })

    return run


def _thresholds(rows: DataFrame, design: Design, n: np.ndarray, seed: int) -> dict[tuple[int, int], np.ndarray]:
    wanted = np.maximum((design.most + 1) ** 2, THRESHOLD_ROWS).reshape(-1, design.n_folds).max(axis=1)
    share = (wanted / n.reshape(-1, design.n_folds).min(axis=1)).tolist()
    if min(share) < 1:
        rows = rows.filter(F.rand(seed) < F.element_at(F.array(*[F.lit(s) for s in share]), F.col("dataset") + 1))
    by_model = [F.array(*[F.col(f"{c}_{k}") for k in range(design.n_folds)]) if c in design.ordered else F.array(c) for c in design.cols]
    long = rows.select("dataset", "fold", F.explode(F.array(*[F.struct(F.lit(i).alias("column"), v.alias("values")) for i, v in enumerate(by_model)])).alias("x"))
    long = long.select("dataset", "fold", "x.column", "x.values")
    found = long.groupBy("dataset", "column").applyInArrow(_column_thresholds(design), "model int, column int, thresholds array<double>").collect()
    return {(r["model"], r["column"]): np.array(r["thresholds"], float) for r in found}


def _blocks(design: Design):
    """Batches of rows to blocks of one data set each: labels as -1 and 1, folds, and the bins by
    model and column."""
    kind = np.uint8 if design.bins <= 256 else np.uint16

    def block(table: pa.Table, dataset: int) -> bytes:
        x = {name: table.column(name).to_numpy() for name in table.column_names}
        bins = np.empty((design.n_folds, len(design.cols), len(table)), kind)
        for k in range(design.n_folds):
            m = dataset * design.n_folds + k
            for i, c in enumerate(design.cols):
                bins[k, i] = np.searchsorted(design.thresholds[m, i], design.values(x[f"{c}_{k}" if c in design.ordered else c], m, i), side="left")
        return pickle.dumps((dataset, 2 * x["label"] - 1, x["fold"].astype(np.int32), bins))

    def run(batches):
        def made(held):
            table = pa.Table.from_batches(held)
            dataset = table.column("dataset").to_numpy()
            out = [block(table.filter(pa.array(dataset == d)), int(d)) for d in np.unique(dataset)]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])

        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield made(held)
                held = []
        if held:
            yield made(held)

    return run


@dataclass
class Trees:
    """One tree of every model; node 1 is the root, 2 i and 2 i + 1 are the children of i."""

    depth: int
    column: np.ndarray  # models x nodes, -1 at a leaf
    bin: np.ndarray  # the last bin that goes left
    value: np.ndarray
    impurity: np.ndarray
    open: np.ndarray  # nodes whose split is not known yet

    @classmethod
    def roots(cls, models: int, depth: int) -> "Trees":
        shape = (models, 2 ** (depth + 1))
        trees = cls(depth, np.full(shape, -1, np.int16), np.zeros(shape, np.int32), np.zeros(shape), np.full(shape, np.nan), np.zeros(shape, bool))
        trees.open[:, 1] = True
        return trees

    def nodes(self, m: int, bins: np.ndarray, level: int) -> np.ndarray:
        """The node that each row has come to after so many levels."""
        at, row = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(level):
            column = self.column[m][at]
            at = np.where(column >= 0, 2 * at + (bins[column, row] > self.bin[m][at]), at)
        return at

    def split(self, m: int, node: int, found: tuple) -> None:
        column, last, gain, *sides = found
        self.open[m, node] = False
        if node == 1:
            self.value[m, 1] = found[3][1] / found[3][0]
        if not gain > 0 or self.depth == 0:
            return
        self.column[m, node], self.bin[m, node] = column, last
        for child, (n, total, _, impurity) in zip((2 * node, 2 * node + 1), sides[1:], strict=True):
            self.value[m, child], self.impurity[m, child] = total / n, impurity
            self.open[m, child] = 2 * child < self.column.shape[1] and abs(impurity) >= PURE


def _residuals(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    if margin is None:
        return y
    with np.errstate(over="ignore"):
        return 4 * y / (1 + np.exp(2 * y * margin))


def _level_sums(trees: Trees, level: int, n_bins: int, first: bool):
    """Tasks over blocks: per model the sums (count, residuals, their squares) x open nodes x columns x
    bins."""

    def run(part, blocks):
        sums = {}
        for dataset, y, fold, bins, margins in blocks:
            n_folds, width = bins.shape[:2]
            for k in range(n_folds):
                m = dataset * n_folds + k
                nodes = np.flatnonzero(trees.open[m])
                if not len(nodes):
                    continue
                slots = np.full(trees.open.shape[1], -1)
                slots[nodes] = np.arange(len(nodes))
                slot = slots[trees.nodes(m, bins[k], level)]
                rows = np.flatnonzero((slot >= 0) & (fold != k))
                r = _residuals(y[rows], None if first else margins[k][rows])
                place = ((slot[rows] * width + np.arange(width)[:, None]) * n_bins + bins[k].take(rows, axis=1)).ravel()
                size, each = len(nodes) * width * n_bins, np.tile(r, width)
                own = np.stack([np.bincount(place, minlength=size), np.bincount(place, each, size), np.bincount(place, each * each, size)]).reshape(3, len(nodes), width, n_bins)
                sums[m] = own if m not in sums else sums[m] + own
        for m, own in sums.items():
            yield m, (part, own)

    return run


def _variance(sums: np.ndarray) -> np.ndarray:
    n, total, squares = sums
    return np.where(n == 0, 0.0, (squares - total * total / n) / n)


def _best_splits(impurity: dict[int, np.ndarray]):
    """Tasks over the partitions' sums of some models: per model and open node the best split, as
    column, last bin to the left, gain, the node's sums, and the sums and impurity of either side. The
    sums are added in the order of the partitions."""

    def best(m: int, parts: list) -> list[tuple]:
        sums = reduce(np.add, [own for _, own in sorted(parts, key=lambda p: p[0])])
        up_to = np.cumsum(sums, axis=-1)
        whole, left = up_to[..., -1:], up_to[..., :-1]
        right = whole - left
        found = []
        with np.errstate(divide="ignore", invalid="ignore"):
            lv, rv = _variance(left), _variance(right)
            n = left[0] + right[0]
            weighted = left[0] / n * lv, right[0] / n * rv
            for s, own in enumerate(impurity[m]):
                split = (left[0, s] >= 1) & (right[0, s] >= 1)
                if not split.any():
                    found.append((-1, 0, 0.0, tuple(whole[:, s, 0, 0].tolist()), None, None))
                    continue
                if np.isnan(own):  # a root
                    column = int(np.flatnonzero(split.any(axis=1))[0])
                    own = _variance(left[:, s, column, 0] + right[:, s, column, 0])
                gain = np.where(split, own - weighted[0][s] - weighted[1][s], -np.inf)
                column, last = np.unravel_index(np.argmax(gain), gain.shape)
                sides = [(*x[:, s, column, last].tolist(), float(v[s, column, last])) for x, v in ((left, lv), (right, rv))]
                found.append((int(column), int(last), float(gain[column, last]), tuple(whole[:, s, column, 0].tolist()), *sides))
        return found

    def run(items):
        parts = {}
        for m, own in items:
            parts.setdefault(m, []).append(own)
        return [(m, best(m, own)) for m, own in parts.items()]

    return run


def _add_trees(trees: Trees, weight: float):
    def run(block):
        dataset, y, fold, bins, margins = block
        new, n_folds = margins.copy(), len(bins)
        for k in range(n_folds):
            m = dataset * n_folds + k
            new[k] += weight * trees.value[m][trees.nodes(m, bins[k], trees.depth)]
        return dataset, y, fold, bins, new

    return run


def _hits(block):
    dataset, y, fold, bins, margins = block
    for k in np.unique(fold).tolist():
        own = fold == k
        yield dataset * len(bins) + k, np.array([((margins[k][own] > 0) == (y[own] > 0)).sum(), own.sum()])


def _grow(blocks: RDD, models: int, n_bins: int, depth: int, first: bool) -> Trees:
    """The next tree of every model: a pass over the rows a level."""
    trees = Trees.roots(models, depth)
    tasks = math.ceil(models / TASK_MODELS)
    for level in range(max(1, depth)):  # the root's mean, too, takes a pass
        nodes = {m: np.flatnonzero(trees.open[m]) for m in range(models) if trees.open[m].any()}
        if not nodes:
            break
        sums = blocks.mapPartitionsWithIndex(_level_sums(trees, level, n_bins, first)).partitionBy(tasks)
        best = _best_splits({m: trees.impurity[m, own] for m, own in nodes.items()})
        for m, found in sums.mapPartitions(best).collect():
            for node, split in zip(nodes[m].tolist(), found, strict=True):
                trees.split(m, node, split)
    return trees


def _drop_checkpoint(rdd: RDD) -> None:
    path = rdd.getCheckpointFile()
    if path:
        folder = rdd.context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(rdd.context._jsc.hadoopConfiguration()).delete(folder, True)


def held_out_accuracy(
    folded: dict[str, DataFrame], cols: Sequence[str], p: Params, bins: Sequence[int], *,
    ordered: Sequence[str] = (), sums: DataFrame | None = None, orders: DataFrame | None = None,
) -> dict[str, list[float]]:
    """Each data set's accuracies, fold by fold, of boosted trees that have not seen the fold. The
    frames hold ``fold``, ``label`` and the columns and are written tables; ``bins`` has each model's
    bins at most, ``sums`` and ``orders`` the categories of the ``ordered`` columns."""
    cols, ordered, n_folds = list(cols), list(ordered), p.n_folds
    cores = next(iter(folded.values())).sparkSession.sparkContext.defaultParallelism

    def union(frames: Sequence[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("dataset"), "fold", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols]) for i, d in enumerate(frames)])

    frames = list(folded.values())
    n, fill = _training(union(frames), cols, ordered, len(frames), n_folds)
    held = n.reshape(-1, n_folds).sum(axis=1) / max(1, n_folds - 1)
    rows = union([d.coalesce(max(1, min(cores, math.ceil(size / PARTITION_ROWS)))) for d, size in zip(frames, held, strict=True)])
    for c in ordered:
        places = broadcast_if_small(fold_places(sums, orders, c, n_folds))
        rows = rows.join(places, (F.col("dataset") == F.col("_dataset")) & F.col(c).eqNullSafe(F.col("_code")), "left").drop("_dataset", "_code", c)
    design = Design(n_folds, cols, ordered, fill, np.minimum(np.array(bins), n) - 1, {})
    design.thresholds.update(_thresholds(rows, design, n, p.gbt_seed))

    start = rows.mapInArrow(_blocks(design), "block binary").rdd.map(lambda r: pickle.loads(r[0]))
    kept = [start.map(lambda b: (*b, np.zeros((n_folds, len(b[1]))))).persist(StorageLevel.MEMORY_AND_DISK)]
    saved: list[RDD] = []
    every = p.gbt_checkpoint_interval
    try:
        for i in range(p.gbt_iters):
            trees = _grow(kept[-1], len(n), design.bins, p.gbt_depth, i == 0)
            while len(kept) > 1:
                kept.pop(0).unpersist()
            if kept[-1].isCheckpointed():
                while saved:
                    _drop_checkpoint(saved.pop())
                saved.append(kept[-1])
            kept.append(kept[-1].map(_add_trees(trees, 1.0 if i == 0 else p.gbt_step)).persist(StorageLevel.MEMORY_AND_DISK))
            if every > 0 and (i + 1) % every == 0 and i + 1 < p.gbt_iters:
                kept[-1].checkpoint()
        hits = dict(kept[-1].flatMap(_hits).reduceByKey(np.add, 1).collect())
    finally:
        for rdd in kept:
            rdd.unpersist()
        while saved:
            _drop_checkpoint(saved.pop())
    return {name: [float(hits[d * n_folds + k][0] / hits[d * n_folds + k][1]) for k in range(n_folds)] for d, name in enumerate(folded)}
