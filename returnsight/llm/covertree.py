"""Near-duplicate vectors by a dual traversal of cover trees.

A cover tree's levels halve their radius: the nodes of a level lie apart by more than its radius,
cover their descendants within it, and are nested, each being its own child below. Two trees are
walked together. A pair of nodes is dropped if their distance less both covering radii is over the
threshold; if their distance plus both radii is below it, all under one link with all under the
other and are counted at once; else their children are paired. Pairs left at the last level are
compared vector by vector, so the result is exact.

Vectors are compared within a label only. Exact copies are one vector with a weight. A label with
more than ``split`` vectors is dealt out by cells around pivots, the upper level of its tree: each
vector has a home cell and visits those cells of its label that neither bound settles. Pivots are
rows chosen by a hash, ``MOST_PIVOTS`` or so at most over all labels, so they can be broadcast."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.llm.common import ready, staged
from returnsight.llm.components import components, forest
from returnsight.llm.vectors import doubles, matrix, tamed, usable, width

#: About one vector in so many becomes a pivot of its label's cells, if the label is split.
CELL = 2048
#: With more vectors than CELL times this, cells grow instead of the pivots' number.
MOST_PIVOTS = 1 << 15
#: Distances nearer than this to a bound are settled by comparing the vectors.
SLACK = 1e-7
PAIRS = 1 << 18


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of x and y, unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class CoverTree:
    """Levels of nodes over unit vectors. ``order`` lists the vectors so that a node's descendants
    are a run; per level: centre (a vector), start of the run, number of nodes below, radius."""

    def __init__(self, unit: np.ndarray, smallest: float):
        self.unit, n = unit, len(unit)
        groups = [np.arange(n)] if n else []
        centres = [0] if n else []
        reach, levels = 2.0, []
        while True:
            levels.append((np.array(centres, np.int64), [len(g) for g in groups], groups))
            if reach <= smallest or all(len(g) == 1 for g in groups):
                break
            reach /= 2
            below, below_centres = [], []
            for centre, group in zip(centres, groups, strict=True):
                for c, members in self._cover(centre, group, reach):
                    below_centres.append(c)
                    below.append(members)
            centres, groups = below_centres, below
        self.order = np.concatenate(levels[-1][2]) if n else np.zeros(0, np.int64)
        self.levels = []
        for centre, sizes, members in levels:
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            radius = np.array([distances(unit[c : c + 1], unit[g]).max() if len(g) > 1 else 0.0 for c, g in zip(centre, members, strict=True)])
            self.levels.append((centre, starts, radius))

    def _cover(self, centre: int, group: np.ndarray, reach: float) -> list[tuple[int, np.ndarray]]:
        """Centres within ``group``, the node's own first, apart by more than ``reach``; everyone
        joins the nearest of the centres found with or after the first that reaches it."""
        if len(group) == 1:
            return [(centre, group)]
        out, left, first = [], group, True
        while len(left):
            block = left[:256]
            if first:
                block = np.concatenate([[centre], block[block != centre]])
            near = distances(self.unit[block], self.unit[block]) <= reach
            chosen: list[int] = []
            covered = np.zeros(len(block), bool)
            for i in range(len(block)):
                if not covered[i]:
                    chosen.append(i)
                    covered |= near[i]
                    covered[i] = True
            far = distances(self.unit[left], self.unit[block[chosen]])
            own = {int(block[c]): k for k, c in enumerate(chosen)}
            nearest = far.argmin(axis=1)
            taken = far[np.arange(len(left)), nearest] <= reach
            for at, vector in enumerate(left.tolist()):
                if vector in own:
                    nearest[at], taken[at] = own[vector], True
            order = np.argsort(nearest[taken], kind="stable")
            members, which = left[taken][order], nearest[taken][order]
            cuts = np.searchsorted(which, np.arange(len(chosen) + 1))
            out += [(int(block[c]), members[cuts[k] : cuts[k + 1]]) for k, c in enumerate(chosen)]
            left, first = left[~taken], False
        return out

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[min(k, len(self.levels) - 1)]


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ..., size[k] of them, for all k."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def dual_traversal(
    one: CoverTree, two: CoverTree, threshold: float, linked: Callable[[np.ndarray, np.ndarray], np.ndarray], weight: np.ndarray, both: bool
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(weight of the vectors of ``two`` that each vector of ``one`` links with, links that connect
    what these connect, as vector numbers of one and two). ``linked`` tests pairs exactly; ``both``:
    the trees are the same, and a vector does not link with itself."""
    count = np.zeros(len(one.order) + 1)  # differences along one.order
    total = np.concatenate([[0.0], np.cumsum(weight[two.order])])
    links: list[tuple[np.ndarray, np.ndarray]] = []
    depth = max(len(one.levels), len(two.levels))
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))] if len(one.order) and len(two.order) else []
    while stack:
        k, a, b = stack.pop()
        if len(a) > PAIRS:
            stack += [(k, x, y) for x, y in zip(np.array_split(a, -(-len(a) // PAIRS)), np.array_split(b, -(-len(a) // PAIRS)), strict=True)]
            continue
        ca, sa, ra = one.level(k)
        cb, sb, rb = two.level(k)
        dot = np.einsum("ij,ij->i", one.unit[ca[a]], two.unit[cb[b]])
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dot))
        open_ = d - ra[a] - rb[b] <= threshold + SLACK
        a, b, d = a[open_], b[open_], d[open_]
        inside = d + ra[a] + rb[b] <= threshold - SLACK
        x, y = a[inside], b[inside]
        if len(x):
            gain = total[sb[y + 1]] - total[sb[y]]
            np.add.at(count, sa[x], gain)
            np.add.at(count, sa[x + 1], -gain)
            if both:  # a vector among those it links with is itself
                same = x == y
                own = _expand(sa[x[same]], sa[x[same] + 1] - sa[x[same]])
                np.add.at(count, own, -weight[one.order[own]])
                np.add.at(count, own + 1, weight[one.order[own]])
            for p, q, s, of, other in ((x, y, sa, one, cb[y]), (y, x, sb, two, ca[x])):
                size = s[p + 1] - s[p]
                members = of.order[_expand(s[p], size)]
                pair = members, np.repeat(other, size)
                links.append(pair if of is one and p is x else pair[::-1])
        a, b = a[~inside], b[~inside]
        if not len(a):
            continue
        if k + 1 < depth:
            na, ba, qa = one.level(k + 1)
            nb, bb, qb = two.level(k + 1)
            fa, fb = np.searchsorted(ba, sa), np.searchsorted(bb, sb)  # first child of every node
            stack += [(k + 1, i, j) for i, j in _products(fa, fb, a, b, one.unit[na], two.unit[nb], qa, qb, threshold)]
            continue
        x, y = one.unit[one.order], two.unit[two.order]
        for i, j in _products(sa, sb, a, b, x, y, np.zeros(len(x)), np.zeros(len(y)), threshold):
            p, q = one.order[i], two.order[j]
            near = linked(p, q)
            if both:
                near &= p != q
            np.add.at(count, i[near], weight[q[near]])
            np.add.at(count, i[near] + 1, -weight[q[near]])
            links.append((p[near], q[near]))
    out = np.zeros(len(one.order))
    out[one.order] = np.cumsum(count[:-1])
    return out, links


def _products(fa, fb, a, b, x, y, rx, ry, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of an element fa[a[k]], ... before fa[a[k] + 1] and one of fb likewise, for all k;
    of large blocks only those that come within the threshold given their radii rx, ry."""
    na, nb = fa[a + 1] - fa[a], fb[b + 1] - fb[b]
    large = na * nb > 2048
    for k in np.flatnonzero(large).tolist():
        i0, j0 = int(fa[a[k]]), int(fb[b[k]])
        right, reach = y[j0 : j0 + int(nb[k])], ry[j0 : j0 + int(nb[k])] + threshold + SLACK
        step = max(1, 4 * PAIRS // len(right))
        for lo in range(i0, i0 + int(na[k]), step):
            hi = min(lo + step, i0 + int(na[k]))
            far = rx[lo:hi, None] + reach[None, :]
            i, j = np.nonzero(2.0 - 2.0 * (x[lo:hi] @ right.T) <= far * far + SLACK)
            if len(i):
                yield i + lo, j + j0
    a, b, na, nb = a[~large], b[~large], na[~large], nb[~large]
    piece = np.cumsum(na * nb) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(a)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo < hi:
            i = _expand(fa[a[lo:hi]], na[lo:hi])
            times = np.repeat(nb[lo:hi], na[lo:hi])
            yield np.repeat(i, times), _expand(np.repeat(fb[b[lo:hi]], na[lo:hi]), times)


def cell_links(rep: np.ndarray, x: np.ndarray, weight: np.ndarray, role: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rep and weight of links for every row, links a, b as reps) of one cell: rows at home (role
    0) among themselves, visiting rows (2) against those at home, which may be copies (1)."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    unit = x / norm[:, None]
    bound = math.sqrt(max(0.0, 2 - 2 * cosine))
    own, guest = np.flatnonzero(role < 2), np.flatnonzero(role == 2)
    tree = CoverTree(unit[own], bound / 4)
    labels = np.arange(len(rep))
    counts = np.zeros(len(rep))
    for rows, other in ((own, tree), (guest, None)):
        if not len(rows) or not len(own) or (other is tree and role[own[0]] == 1):
            continue
        one = other or CoverTree(unit[rows], bound / 4)

        def linked(p: np.ndarray, q: np.ndarray, rows: np.ndarray = rows) -> np.ndarray:
            i, j = rows[p], own[q]
            return np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= cosine

        counts[rows], links = dual_traversal(one, tree, bound, linked, weight[own], other is tree)
        for p, q in links:
            forest(len(rep), rows[p], own[q], labels)
    moved = np.flatnonzero(labels != np.arange(len(rep)))
    return rep, np.rint(counts).astype(np.int64), rep[moved], rep[labels[moved]]


def _cells(dim: int, cosine: float):
    """Tasks over rows sorted by cell: rows (rep, n) of counts, and (a, b) of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append((*(batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)), matrix(batch.column(4), dim)))
            if not held:
                continue
            if batch is not None and held[0][0][0] == held[-1][0][-1]:
                continue
            cell, rep, weight, role, x = (np.concatenate(c) for c in zip(*held, strict=True))
            cut = len(cell) if batch is None else int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            edges = [0, *(np.flatnonzero(cell[1:cut] != cell[: max(0, cut - 1)]) + 1).tolist(), cut]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo < hi:
                    r, n, a, b = cell_links(rep[lo:hi], x[lo:hi], weight[lo:hi].astype(float), role[lo:hi], cosine)
                    none = np.zeros(len(a), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in ((r, a), (n, none), (r, b))], ["a", "n", "b"])
            held = [(cell[cut:], rep[cut:], weight[cut:], role[cut:], x[cut:])] if cut < len(cell) else []

    return run


def _visits(dim: int, bound: float, shared):
    """Rows (label, rep, weight, vector) to rows (cell, rep, weight, home, vector, gain, pivot): the
    home cell, cells to visit, and, with no vector, links with cells that lie within the threshold as a
    whole (``gain``: their weight). ``shared``: broadcast of label -> (numbers, reps, units, radii, weights),
    and None as a further key once radii and weights are known; before, only homes are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            x = matrix(batch.column(3), dim)
            unit = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            found: list[tuple] = []
            for one in np.unique(label):
                rows = np.flatnonzero(label == one)
                if one not in pivots:  # not split: the label is one cell
                    found.append((rows, np.full(len(rows), -1), np.ones(len(rows), bool), np.zeros(len(rows))))
                    continue
                _, _, units, radii, _ = pivots[one]
                for lo in range(0, len(rows), 1024):
                    some = rows[lo : lo + 1024]
                    d = distances(unit[some], units)
                    home = d.argmin(axis=1)
                    at = np.arange(len(some))
                    found.append((some, home, np.ones(len(some), bool), d[at, home]))
                    if None in pivots:
                        near = d - radii[None, :] <= bound + SLACK
                        near[at, home] = False
                        whole = near & (d + radii[None, :] <= bound - SLACK)
                        i, j = np.nonzero(near & ~whole)
                        found.append((some[i], j, np.zeros(len(i), bool), d[i, j]))
                        i, j = np.nonzero(whole)
                        if len(i):
                            yield _whole_rows(batch, one, some, i, j, pivots[one])
            for rows, cell, home, d in found:
                if len(rows):
                    yield _visit_rows(batch, label, rows, cell, home, d)

    return run


VISIT = "label long, cell int, rep long, weight long, home boolean, distance double, vector array<double>, gain long, pivot long"


def _visit_rows(batch, label, rows, cell, home, d) -> pa.RecordBatch:
    """Rows that are at home in a cell or visit it."""
    at, none = pa.array(rows), np.zeros(len(rows), np.int64)
    columns = [pa.array(label[rows], pa.int64()), pa.array(cell, pa.int32()), batch.column(1).take(at), batch.column(2).take(at), pa.array(home), pa.array(d, pa.float64()), batch.column(3).take(at), pa.array(none), pa.array(none)]
    return pa.RecordBatch.from_arrays(columns, ["label", "cell", "rep", "weight", "home", "distance", "vector", "gain", "pivot"])


def _whole_rows(batch, label, some, i, j, of) -> pa.RecordBatch:
    """Links, without vectors, of rows ``some[i]`` that link with all of cell ``j``: each row once, to its
    first cell's pivot with the gain of all its cells, and these cells' pivots to that one, each pair
    once a batch. A tight group's rows thus stay in proportion to its vectors."""
    _, reps, _, _, weights = of
    first = np.concatenate([[True], i[1:] != i[:-1]])
    starts = np.flatnonzero(first)
    lead = j[starts][np.cumsum(first) - 1]
    pairs = np.unique(np.column_stack([lead, j])[~first], axis=0)
    rep = np.concatenate([batch.column(1).to_numpy()[some[i[starts]]], reps[pairs[:, 1]]])
    gain = np.concatenate([np.add.reduceat(weights[j], starts), np.zeros(len(pairs), np.int64)])
    cell = np.concatenate([j[starts], pairs[:, 0]])
    n = len(rep)
    columns = [pa.array(np.full(n, label), pa.int64()), pa.array(cell, pa.int32()), pa.array(rep, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n)), pa.nulls(n, batch.column(3).type), pa.array(gain.astype(np.int64)), pa.array(reps[cell], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["label", "cell", "rep", "weight", "home", "distance", "vector", "gain", "pivot"])


def near_vectors(rows: DataFrame, cosine: float = 0.93, split: int = 2 * CELL) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding, label): vec_id, n_links (other rows of equal
    label with a cosine of at least ``cosine``), component_id (smallest vec_id that links reach),
    kept (vec_id = component_id).

    Rows whose label or vector is null, or whose vector is empty, zero or holds a null or non-finite
    component, link with nothing and are their own component. Shorter vectors count as padded with
    zeros. Repeated ids are rows of their own. Labels that are not integers are told apart by a 64-bit
    hash. An empty table gives no rows; other columns are ignored."""
    spark = ready(rows).sparkSession
    label = F.col("label") if dict(rows.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint") else F.when(F.col("label").isNotNull(), F.xxhash64("label"))
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), tamed(doubles(F.col("embedding"))).alias("vector"), label.cast("long").alias("label"))
    taking = F.col("label").isNotNull() & usable(F.col("vector"))
    classes = own.where(taking).groupBy("label", "vector").agg(F.count("*").alias("weight"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    dim, bound = width(classes, "vector"), math.sqrt(max(0.0, 2 - 2 * cosine))

    sizes = staged(classes.groupBy("label").count().where(F.col("count") > split).select(F.col("label").alias("big")), "big-labels")
    chance = max(CELL, -(-classes.count() // MOST_PIVOTS))
    chosen = classes.join(sizes, F.col("label") == F.col("big"), "left_semi").where(F.pmod(F.xxhash64("vector"), F.lit(chance)) == 0)
    pivots = _pivots(chosen.select("label", "rep", "vector").orderBy("label", "rep").collect(), dim)  # MOST_PIVOTS or so at most

    dealt = classes.select("label", "rep", "weight", "vector")
    if pivots:
        homes = dealt.mapInArrow(_visits(dim, bound, spark.sparkContext.broadcast(pivots)), VISIT)
        for r in homes.where("cell >= 0").groupBy("label", "cell").agg(F.max("distance").alias("radius"), F.sum("weight").alias("weight")).collect():
            _, _, _, radii, weights = pivots[r["label"]]
            radii[r["cell"]], weights[r["cell"]] = r["radius"], r["weight"]
    visits = dealt.mapInArrow(_visits(dim, bound, spark.sparkContext.broadcast(pivots | {None: True})), VISIT)
    visits = staged(visits, "visits") if pivots else visits
    work = _dealt_out(visits.where("vector IS NOT NULL"), bool(pivots))
    pairs = staged(work.repartition("key").sortWithinPartitions("key").mapInArrow(_cells(dim, cosine), "a long, n long, b long"), "cell-links")
    if pivots:
        pairs = pairs.unionByName(visits.where("vector IS NULL").select(F.col("rep").alias("a"), F.col("gain").alias("n"), F.col("pivot").alias("b")))
    counts = pairs.groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("others"))
    roots = components(pairs.select("a", "b"))

    known = classes.join(counts, F.col("rep") == F.col("of"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    known = known.select(
        F.col("label").alias("of_label"), F.col("vector").alias("of_vector"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root")
    )
    same = (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of_vector"))
    found = staged(own.where(taking).join(known, same).select("vec_id", "n_links", "root"), "vector-links")
    # written first: both sides of the join are then plain shuffles, whose hot partitions AQE splits
    first = staged(found.groupBy(F.col("root").alias("of_root")).agg(F.min("vec_id").alias("component_id")), "smallest")
    linked = found.join(first, F.col("root") == F.col("of_root")).select("vec_id", "n_links", "component_id")
    alone = own.where(~taking).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _pivots(rows: list, dim: int) -> dict:
    """label -> (numbers, reps, unit vectors, radii, weights), the last two still to be filled in."""
    found: dict = {}
    for r in rows:
        found.setdefault(r["label"], []).append((r["rep"], np.pad(r["vector"], (0, dim - len(r["vector"])))))
    out = {}
    for label, own in found.items():
        x = np.array([v for _, v in own])
        unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
        out[label] = np.arange(len(x)), np.array([rep for rep, _ in own]), unit, np.full(len(x), -np.inf), np.zeros(len(x), np.int64)
    return out


#: Visitors of a cell that one task takes; the cell's own rows go along with each such share.
VISITORS = 16384


def _dealt_out(visits: DataFrame, split: bool) -> DataFrame:
    """Rows (key, rep, weight, role, vector): cells with many visitors several times, each with a
    share of the visitors."""
    key = F.xxhash64("label", "cell", "share")
    if not split:
        return visits.withColumn("share", F.lit(0).cast("long")).select(key.alias("key"), "rep", "weight", F.lit(0).alias("role"), "vector")
    crowd = visits.where("NOT home").groupBy("label", "cell").count().where(F.col("count") > VISITORS)
    crowd = crowd.select(F.col("label").alias("of_label"), F.col("cell").alias("of_cell"), F.ceil(F.col("count") / VISITORS).alias("shares"))
    crowd = staged(crowd, "crowded-cells")  # MOST_PIVOTS rows or so at most
    rows = visits.join(F.broadcast(crowd), (F.col("label") == F.col("of_label")) & (F.col("cell") == F.col("of_cell")), "left")
    shares = F.coalesce("shares", F.lit(1).cast("long"))
    share = F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), shares - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), shares)))
    rows = rows.withColumn("share", F.explode(share))
    role = F.when(~F.col("home"), 2).when(F.col("share") == 0, 0).otherwise(1)
    return rows.select(key.alias("key"), "rep", "weight", role.cast("int").alias("role"), "vector")
