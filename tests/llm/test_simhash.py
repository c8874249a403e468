"""Operator 1 against brute force."""

import random

import numpy as np
import pytest
import xxhash

from returnsight.llm.components import components, forest
from returnsight.llm.simhash import Tries, fingerprint, linked_fingerprints, simhash_groups


def plain_fingerprint(text, k=4):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    value = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g.encode(), 42) >> bit & 1 for g in grams) > len(grams):
            value |= 1 << bit
    return value


def brute_groups(values, budget):
    """Smallest index reachable, over all pairs."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def clustered(rng, n):
    centres = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a b c", "A b C d", "a\x0bb\x85c   É é d e f g", "word " * 500])
def test_fingerprint(text):
    assert fingerprint(text, 4) == plain_fingerprint(text)


@pytest.mark.parametrize("seed,budget,frontier", [(s, b, f) for s in range(4) for b in (0, 1, 4) for f in (16, 1 << 19)])
def test_trie_walk(seed, budget, frontier):
    values = clustered(random.Random(seed), 150)
    labels = Tries(np.zeros(len(values), np.int64), np.array(values, np.uint64)).components(budget, frontier)
    assert labels.tolist() == brute_groups(values, budget)


def test_trie_walk_keeps_groups_apart():
    bits = np.array([0, 1, 1, 2, 1 << 63], np.uint64)
    assert Tries(np.array([0, 0, 1, 1, 1]), bits).components(2).tolist() == [0, 0, 2, 2, 2]


def as_long(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("hot", [2, 5, 4096])
def test_hot_values_are_split_without_loss(spark, hot):
    rng = random.Random(hot)
    values = clustered(rng, 200) + [(0xABC << 52) | rng.getrandbits(20) for _ in range(150)]  # shared blocks
    values = sorted(set(values))
    links = linked_fingerprints(spark.createDataFrame([(as_long(v),) for v in values], "fp long"), 4, hot=hot).collect()
    at = {as_long(v): k for k, v in enumerate(values)}
    for r in links:
        assert (values[at[r.a]] ^ values[at[r.b]]).bit_count() <= 64
    label = forest(len(values), np.array([at[r.a] for r in links]), np.array([at[r.b] for r in links]))
    assert label.tolist() == brute_groups(values, 4)


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = forest(500, np.array([a for a, _ in links]), np.array([b for _, b in links]))
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert set(got) == nodes
    assert {(got[a] == got[b]) == (label[a] == label[b]) for a in nodes for b in nodes} == {True}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_edges(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(50 + i, " ".join(w[:-1] + ["Changed"])) for i, w in enumerate(base)] + [(80 + i, " ".join(base[0]).upper()) for i in range(9)]
    rows += [(200, None), (201, ""), (202, "\n"), (203, "one"), (204, "ONE"), (204, "one"), (None, "one"), (None, None), (205, "word " * 40000)]
    docs = spark.createDataFrame([(i, t, "f", 1, "r") for i, t in rows], "doc_id long, text string, fp string, key int, root string").repartition(4)
    got = simhash_groups(docs).collect()
    values = [plain_fingerprint(t) for _, t in rows]
    label = brute_groups(values, 4)
    smallest = {}
    for (i, _), k in zip(rows, label, strict=True):
        smallest[k] = min((x for x in (i, smallest.get(k)) if x is not None), default=None)
    want = [(i, f"{v:016x}", smallest[k]) for (i, _), v, k in zip(rows, values, label, strict=True)]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert simhash_groups(docs.limit(0)).collect() == []
