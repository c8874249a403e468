"""Operators 11 to 13 against brute force."""

import math
import re

import numpy as np
import pytest

from returnsight.llm import topk
from returnsight.llm.balltree import GROUPS, NONE, Block, build, groups_of, lexical_search, search, terms_of, vectors
from returnsight.llm.topk import exact_scores, qualifying, sorted_lists, top_products
from returnsight.llm.whitening import components_of, polar_factor, whiten

DOCS = "doc_id long, text string, item_id string, term int, n double"
ITEMS = "item_id long, text string, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_ranking(docs, items, k=10):
    found = [words(t) for _, t in docs]
    n_docs, n_terms = sum(map(bool, found)), sum(map(len, found))
    df, out = {}, []
    for own in found:
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    for item, own in asked.items():
        scores = []
        for (doc_id, _), terms in zip(docs, found, strict=True):
            score = 0
            for t in own & set(terms):
                m = 100 - 90 + 90 * len(terms) * n_docs // n_terms
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * terms.count(t) // (1000 * terms.count(t) + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def documents(rng, n=300):
    names = [f"w{j}" for j in range(60)] + ["Été", "ЖУК", "a b", "x_y", "I"]
    p = 1 / np.arange(1, len(names) + 1)
    docs = [(i, " ".join(rng.choice(names, rng.integers(1, 60), p=p / p.sum()))) for i in range(n)]
    docs += [(1000 + i, docs[3][1]) for i in range(120)]  # a large group of copies
    docs += [(5, docs[7][1]), (5, docs[8][1]), (None, docs[3][1]), (None, docs[9][1]), (2000, None), (2001, ""), (2002, "?!, .")]
    return docs + [(2003, "w1 w2 w3 " * 4000)]


def items():
    return [(1, "w1 W2, w3 w50"), (2, None), (3, "w40 w41 w42 w43 w59"), (3, "ЖУК"), (4, "nowhere"), (None, "w5 Été w6"), (5, "w2 w3"), (6, "")]


def test_terms():
    for text in ["", "Aa-b_c\tÀ  b\x1cZ[`{\x7f9", "ΣΑΣ xİIı"]:
        assert [t.decode() for t in terms_of(text.encode())] == words(text)


@pytest.mark.parametrize("block_terms", [16_384, 5])
def test_lexical_search(spark, block_terms):
    docs = documents(np.random.default_rng(0))
    frame = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(i, t, "y") for i, t in items()], ITEMS)
    got = sorted(map(tuple, lexical_search(frame, asked, block_terms=block_terms).collect()), key=str)
    assert got == brute_ranking(docs, items())


def test_an_item_of_very_many_terms(spark):
    docs = documents(np.random.default_rng(1), 60)
    long_item = " ".join(f"t{j}" for j in range(60_000)) + " w1 w2 w40"
    frame = spark.createDataFrame([(i, t, "x", 1, 0.5) for i, t in docs], DOCS).repartition(2)
    asked = spark.createDataFrame([(1, long_item, "y"), (2, "w3 w4", "y")], ITEMS)
    got = sorted(map(tuple, lexical_search(frame, asked).collect()), key=str)
    assert got == brute_ranking(docs, [(1, "w1 w2 w40"), (2, "w3 w4")])


def test_lexical_search_without_rows(spark):
    none, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "")], ITEMS)
    some = spark.createDataFrame([(1, "a b", "x", 1, 0.5)], DOCS)
    assert lexical_search(none, asked).collect() == []
    assert lexical_search(some, asked.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in lexical_search(some, asked).collect()] == [(1, 1, 1)]


def test_ball_tree_bounds_and_pruning():
    rng = np.random.default_rng(5)
    n, width = 2000, 300
    topic = rng.integers(0, 10, n)  # documents of a topic share their terms
    sets = [np.unique(np.concatenate([rng.integers(30 * t, 30 * t + 30, 12), rng.integers(0, width, 2)])) for t in topic]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    terms = np.concatenate(sets)
    asked = [sets[i][:8] for i in range(0, n, 100)]
    block = Block(list(range(len(asked))), np.concatenate([[0], np.cumsum([len(a) for a in asked])]), np.concatenate(asked), rng.integers(100, 9000, width), n, 14 * n, 10)
    rows = vectors(block, [14] * n, starts, terms, rng.integers(1, 4, len(terms)))
    group = groups_of(block.weights)
    tree = build(rows, group)
    dense = np.zeros((n, width))
    dense[rows.row_numbers(), rows.terms] = rows.values
    below = {}
    for node in reversed(range(len(tree.radius))):
        below[node] = tree.leaves[node][0] if tree.children[node] is None else np.concatenate([below[c] for c in tree.children[node]])
        apart = dense[below[node]] - tree.centroids[node]
        for g in range(0, GROUPS, 15):
            assert np.linalg.norm(apart[:, group == g], axis=1).max() <= tree.radius[node][g]
        assert np.allclose(tree.centroids[node], dense[below[node]].mean(axis=0))
    assert sorted(below[0].tolist()) == list(range(n))
    best = [NONE] * len(asked)
    scored = search(tree, np.zeros(n, bool), np.arange(n), block, best)
    for a, b in zip(asked, best, strict=True):
        score = dense[:, a].sum(axis=1)
        order = np.lexsort((np.arange(n), -score))[:10]
        assert b.doc_id.tolist() == order.tolist() and b.score.tolist() == score[order].tolist()
    assert scored < 0.6 * len(asked) * len(tree.leaves)


def test_equal_documents_are_one_leaf():
    rows = vectors(Block([0], np.array([0, 2]), np.array([0, 1]), np.array([5, 7]), 100, 200, 10), [2] * 100, np.arange(0, 201, 2), np.tile([0, 1], 100), np.ones(200))
    tree = build(rows, np.array([0, 1]))
    assert tree.children == [None] and len(tree.leaves[0][0]) == 100


VECTORS = "vec_id long, embedding array<float>, label int, x string, rank int"


def vector_rows(rng, n=700, dim=12):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(1000 + i, x[1].tolist()) for i in range(300)]  # copies, some asking
    rows += [(200, x[5].tolist()), (200, x[6].tolist()), (300, x[300].tolist()), (-100, [0.0] * dim), (2000, [1.0, -2.0]), (2001, [])]
    bad = [None, [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [None] + [1.0] * (dim - 1)]
    return rows + [(3000 + 100 * i, v) for i, v in enumerate(bad)] + [(None, x[2].tolist())]


def valid(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", 2) for i, v in rows], VECTORS).repartition(3)


def as_ints(rows, scale, dim):
    own = [(i, v) for i, v in rows if valid(v)]
    x = [[math.floor(scale * float(np.float32(c))) for c in v] + [0] * (dim - len(v)) for _, v in own]
    return [i for i, _ in own], np.array(x, object)


@pytest.mark.parametrize("segment,chunk_bytes", [(8192, 32 << 20), (64, 300)])
def test_top_products(spark, monkeypatch, segment, chunk_bytes):
    monkeypatch.setattr(topk, "SEGMENT", segment)
    monkeypatch.setattr(topk, "FIRST", segment // 2)
    rows = vector_rows(np.random.default_rng(2))
    ids, x = as_ints([r for r in rows if r[0] is not None], 1024, 12)
    want = []
    for q in {i for i in ids if i % 100 == 0}:
        asking = {tuple(x[j]) for j, i in enumerate(ids) if i == q}
        scores = [(-int(np.dot(x[j], np.array(v, object))), ids[j]) for v in asking for j in range(len(ids)) if ids[j] != q]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    got = top_products(frame(spark, rows), chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_products_few_rows(spark):
    assert top_products(frame(spark, []).limit(0)).collect() == []
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (7, [-1.0, 0.0])]
    got = sorted(map(tuple, top_products(frame(spark, rows)).collect()))
    m = 1024 * 1024
    assert got == [(0, 1, 100, m), (0, 2, 3, m // 2), (0, 3, 7, -m), (100, 1, 0, m), (100, 2, 3, m // 2), (100, 3, 7, -m)]


def test_top_products_of_huge_components(spark):
    rows = [(0, [3e38, 1.0]), (1, [3e38, 1.0]), (2, [-3e38, 0.0]), (3, [0.0, 2.0])]
    got = {r.vec_id: r.score for r in top_products(frame(spark, rows)).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63), 3: 2048 * 1024}


@pytest.mark.parametrize("bounded", [False, True])
def test_reading_stops_early_and_loses_nothing(bounded):
    rng = np.random.default_rng(9)
    x = np.floor(1024 * rng.normal(size=(3000, 32))).astype(np.int64)
    x[::7] = x[0]  # a seventh are equal
    ids, read = np.arange(3000), 0
    lists = sorted_lists(ids, x)
    for q in range(1, 40):
        score = x @ x[q]
        score[q] = np.iinfo(np.int64).min
        best = np.sort(score)[-10]
        rows = qualifying(lists, q, x[q], 10, float(best) if bounded else -np.inf)
        assert set(np.flatnonzero(score > best)) <= set(rows.tolist())
        assert set(np.flatnonzero(score == best)) <= set(rows.tolist())
        read += len(rows)
    assert read < 39 * 3000 / 4


def test_exact_scores_beyond_longs():
    x = np.array([[2**62, 2**62], [-(2**62), -(2**62)], [1, 2]])
    assert exact_scores(x, np.array([3, 3])).tolist() == [2**63 - 1, -(2**63), 9]


def brute_whitening(rows, dim, scale=256):
    ids, x = as_ints(rows, scale, dim)
    fit = np.array(sorted(set(map(tuple, x))), float)
    n, mean = len(fit), fit.mean(axis=0)
    v = (fit - mean).T @ (fit - mean) / n
    values, vectors_ = np.linalg.eigh(v)
    sums = [sum(col) for col in zip(*sorted(set(map(tuple, x))), strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return ids, x.astype(float), n, mean, values[::-1], vectors_[:, ::-1], np.trace(v), deviation


def test_whitening(spark):
    rows = vector_rows(np.random.default_rng(7))
    got = [tuple(r) for r in whiten(frame(spark, rows)).collect()]
    ids, x, n, mean, values, vectors_, trace, deviation = brute_whitening(rows, 12)
    want = (x - mean) @ vectors_[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * len(ids) and {g[2] for g in got} == {n}
    assert max(g[6] for g in got) == min(g[6] for g in got) < 1e-9
    # rows of one id and one component, whichever sign a component has
    for c in range(1, 5):
        mine = sorted([((g[0] is None, g[0] or 0), g[3], g[4]) for g in got if g[1] == c])
        both = []
        for sign in (1, -1):
            theirs = sorted([((i is None, i or 0), d, sign * w) for i, d, w in zip(ids, deviation, want[:, c - 1], strict=True)])
            assert [m[:2] for m in mine] == [t[:2] for t in theirs]
            both.append(max(abs(m[2] - t[2]) for m, t in zip(mine, theirs, strict=True)))
        assert min(both) < 1e-8
        assert all(abs(g[5] / (values[c - 1] / trace) - 1) < 1e-9 for g in got if g[1] == c)


def test_whitening_of_flat_tables(spark):
    assert whiten(frame(spark, []).limit(0)).collect() == []
    assert whiten(frame(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    line = whiten(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [2.0, 2.0])])).collect()
    assert sorted((r.vec_id, r.component, r.n) for r in line) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (4, 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 for r in line)
    huge = whiten(frame(spark, [(1, [3e38, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 2.0])])).collect()
    assert {r.deviation for r in huge} == {None}


def test_polar_factor():
    a = np.random.default_rng(1).normal(size=(20, 20))
    a = a + a.T
    values, vectors_ = np.linalg.eigh(a)
    assert np.abs(polar_factor(a) - vectors_ @ np.diag(np.sign(values)) @ vectors_.T).max() < 1e-12


@pytest.mark.parametrize("values", [np.arange(1.0, 41), np.r_[np.ones(20), 2 * np.ones(10), 10 * np.ones(3)], 10.0 ** -np.arange(30), np.ones(5), np.r_[5.0, np.zeros(9)], np.r_[1e6, 1 + 1e-9 * np.arange(6)]])
def test_components(values):
    rng = np.random.default_rng(len(values))
    basis = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    a = basis @ np.diag(values) @ basis.T
    a = (a + a.T) / 2
    for count in (1, 4, len(values)):
        got, own = components_of(a, count)
        size = np.abs(values).max()
        assert np.allclose(got, np.sort(values)[::-1][:count], atol=1e-12 * size, rtol=0)
        assert np.abs(own.T @ own - np.eye(own.shape[1])).max() < 1e-12
        assert np.abs(a @ own - own * got).max() < 1e-12 * size
