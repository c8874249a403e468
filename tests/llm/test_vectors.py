"""Operators 6 and 7 against brute force."""

import numpy as np
import pytest

from returnsight.llm import covertree
from returnsight.llm.ann import adaptive_scan, nearest
from returnsight.llm.covertree import CoverTree, cell_links, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, vector int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "a", 1, "b") for i, v, k in rows], SCHEMA).repartition(4)


def clustered(rng, n, dim=16):
    x = rng.normal(size=(n, dim))
    for k in range(n // 3):  # chains and tight groups
        x[n - 1 - k] = x[k % 20] + rng.normal(size=dim) * rng.choice([0.01, 0.1, 0.25])
    return x.astype(np.float32)


def edge_rows(rng, n=260):
    x = clustered(rng, n)
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(n)]
    rows += [(1000 + i, x[0].tolist(), 0) for i in range(45)]  # a large group of copies
    rows += [(1100, (2 * x[0]).tolist(), 0), (1101, x[0].tolist(), 1), (1102, x[0].tolist(), None)]
    bad = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(1200 + i, v, 0) for i, v in enumerate(bad)]
    rows += [(1300, [1.0, 2.0], 2), (1301, [1.0, 2.0, 0.0], 2), (1320, [1.0] * 16, 2), (1320, [1.0] * 16, 2), (1321, [1e-30] * 16, 2)]
    return rows


def valid(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(c != 0 for c in v)


def padded(rows):
    return np.array([np.pad(np.array(v, np.float32).astype(float), (0, 16 - len(v))) for v in rows])


@pytest.mark.parametrize("cell,visitors", [(2048, 16384), (16, 16384), (16, 8)])
def test_near_vectors(spark, monkeypatch, cell, visitors):
    monkeypatch.setattr(covertree, "CELL", cell)
    monkeypatch.setattr(covertree, "VISITORS", visitors)
    rows = edge_rows(np.random.default_rng(3))
    own = [r for r in rows if valid(r[1]) and r[2] is not None]
    x = padded([v for _, v, _ in own])
    norm = np.sqrt((x * x).sum(axis=1))
    cosine = (x @ x.T) / norm[:, None] / norm[None, :]
    assert not ((cosine > 0.93 - 1e-9) & (cosine < 0.93 + 1e-9)).any()
    link = (cosine >= 0.93) & np.equal.outer([k for *_, k in own], [k for *_, k in own])
    np.fill_diagonal(link, False)
    label = np.arange(len(own))
    for _ in range(len(own)):
        label = np.array([min([label[i], *label[link[i]]]) for i in range(len(own))])
    ids = np.array([i for i, *_ in own])
    want = [(int(ids[i]), int(link[i].sum()), int(ids[label == label[i]].min())) for i in range(len(own))]
    want += [(i, 0, i) for i, v, k in rows if not (valid(v) and k is not None)]
    got = near_vectors(frame(spark, rows), 0.93, split=2 * cell)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def test_near_vectors_without_rows(spark):
    assert near_vectors(frame(spark, []).limit(0)).collect() == []
    assert [tuple(r) for r in near_vectors(frame(spark, [(5, None, 1)])).collect()] == [(5, 0, 5, True)]


def test_cover_tree_invariants():
    x = clustered(np.random.default_rng(1), 400).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    tree = CoverTree(unit, 0.09)
    assert sorted(tree.order) == list(range(400))
    before, reach = {0}, 2.0
    for centre, starts, radius in tree.levels:
        assert before <= set(centre.tolist())  # nested
        before = set(centre.tolist())
        for k, c in enumerate(centre):
            members = tree.order[starts[k] : starts[k + 1]]
            d = np.linalg.norm(unit[members] - unit[c], axis=1)
            assert d.max() <= radius[k] + 1e-7 and radius[k] <= reach + 1e-7 and c in members
        reach /= 2


@pytest.mark.parametrize("spread", [0.02, 0.2, 0.6, 3.0])
def test_cell_links_by_spread(spread):
    rng = np.random.default_rng(int(spread * 100))
    x = rng.normal(size=8) * 2 + rng.normal(size=(300, 8)) * spread
    role = np.where(np.arange(300) < 180, 0, 2)
    weight = rng.integers(1, 5, 300).astype(float)
    rep, n, a, b = cell_links(np.arange(300), x, weight, role, 0.93)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    assert n.tolist() == [int((near[i, :180] * weight[:180]).sum()) for i in range(300)]


def brute_neighbours(rows, every, k):
    own = [(i, v) for i, v, _ in rows if valid(v)]
    x, out = padded([v for _, v in own]), []
    for q in {(i, tuple(v)) for i, v in own if i % every == 0}:
        score = x @ np.pad(np.array(q[1], np.float32).astype(float), (0, 16 - len(q[1])))
        best = sorted({(-s, i) for s, (i, _) in zip(score, own, strict=True) if i != q[0]})[:k]
        out += [(q[0], r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_neighbours_full_probe_is_exact(spark):
    rows = edge_rows(np.random.default_rng(4))
    got = sorted(map(tuple, nearest(frame(spark, rows), every=20, k=20, probed=1.0).collect()))
    want = brute_neighbours(rows, 20, 20)
    assert len(got) == len(want)
    mine = {(q, r): s for q, r, _, s in got}
    assert all(abs(mine[q, r] - s) < 1e-4 * max(1, abs(s)) for q, r, _, s in want)
    hits = len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want})
    assert hits >= 0.99 * len(want)


def test_neighbours_few_rows(spark):
    assert nearest(frame(spark, []).limit(0)).collect() == []
    rows = [(0, [1.0, 0.0], 1), (20, [1.0, 0.0], 1), (3, [0.5, 0.5], None), (40, None, 1), (7, [-1.0, 0.0], 1)]
    got = sorted(map(tuple, nearest(frame(spark, rows)).collect()))
    assert got == [(0, 1, 20, 1.0), (0, 2, 3, 0.5), (0, 3, 7, -1.0), (20, 1, 0, 1.0), (20, 2, 3, 0.5), (20, 3, 7, -1.0)]


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = rows.collect()
    x = np.array([r.embedding for r in data], float)
    ids = np.array([r.vec_id for r in data])
    found = {}
    for r in nearest(rows).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]].tolist())
        hits, total = hits + len(best & found[ids[q]]), total + 20
    assert hits / total >= 0.9


def test_adaptive_scan_keeps_the_nearest():
    rng = np.random.default_rng(0)
    c, q = rng.normal(size=(800, 65)), rng.normal(size=(30, 65))
    i, j = adaptive_scan(q, c, 21)
    assert 21 * 30 <= len(i) < 25 * 30
    d = ((q[:, None] - c[None]) ** 2).sum(axis=2)
    kept = set(zip(i.tolist(), j.tolist(), strict=True))
    best = [(k, int(n)) for k in range(30) for n in np.argsort(d[k])[:21]]
    assert sum(p in kept for p in best) >= 0.99 * len(best)
    assert {(int(a), int(b)) for a, b in zip(*adaptive_scan(q, c, 21, epsilon=1e9), strict=True)} == set(best)
