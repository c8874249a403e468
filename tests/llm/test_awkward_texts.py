"""Texts made to be slow or to break something: long single chunks, long digit runs, many inserted words."""

import itertools
import math
import random
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from returnsight.llm import secret_scan, toxicity
from returnsight.llm.bpe import LONG, WordBpe
from returnsight.llm.covertree import _visits, near_vectors
from returnsight.llm.licenses import TEMPLATES, chained, find_licenses
from returnsight.llm.records import read_records, read_shard, write_records
from returnsight.llm.secret_scan import COMMON_WORDS, DATE, DATE_BITS, MIN_GUESS_BITS, SEGMENT_BITS, find_spans, guess_bits, masked_text
from returnsight.llm.tokens import vocabulary_path

MB = 1_000_000


def long_chunks():
    rng = random.Random(1)
    letters = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=MB))
    return {
        "letter": "a" * MB,
        "signs": "a" + "=" * MB + "a",
        "digits": "".join(rng.choices("0123456789", k=MB)),
        "letters": letters,
        "ports": "://a:80/" * (MB // 8) + '"@',
        "passwords": "://u:p" * (MB // 6) + "@h",
        "assignments": 'password="' * (MB // 10),
        "value": "password: " + letters[: MB // 2],
        "walk": "pwd: " + "qwertyuiopoiuytrew" * (MB // 18),
        "spaced": "s c u m " * (MB // 8),
    }


CHUNKS = long_chunks()
SECONDS = 90  # on a slow machine; the point is that none takes many minutes


@pytest.mark.parametrize("name", CHUNKS)
def test_long_chunks_take_seconds(name):
    text = CHUNKS[name]
    scorer = toxicity.Scorer(np.full((toxicity.LETTERS,) * 3, 3.0).tolist(), {"scum": 2.0})
    for work in (lambda: find_spans(text, MIN_GUESS_BITS), lambda: find_licenses(text), lambda: scorer.measures(text)):
        began = time.process_time()
        work()
        assert time.process_time() - began < SECONDS


@pytest.mark.parametrize("name", ["letter", "digits", "letters"])
def test_long_words_are_merged_in_seconds(name):
    model = WordBpe(vocabulary_path())
    word = CHUNKS[name].lower()
    began = time.process_time()
    (ids, sizes) = model.encode_words([word, "short", word[:LONG], word[: LONG + 1]])
    assert time.process_time() - began < SECONDS
    assert len(ids) == sizes.sum()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    ends = np.cumsum(sizes)
    for k, w in enumerate([word, "short", word[:LONG], word[: LONG + 1]]):
        if w.isalpha() or len(w) > 10:
            assert ids[ends[k] - sizes[k] : ends[k]].tolist() == library.encode(w, add_special_tokens=False).ids or not w.isalpha()


def test_long_and_short_words_are_merged_alike():
    model, rng = WordBpe(vocabulary_path()), random.Random(4)
    for _ in range(150):
        word = "".join(rng.choices("aaabetihns", k=rng.randint(1, 120)))
        symbols = model.inner[np.frombuffer(word.encode(), np.uint8)]
        symbols[-1] = model.last[word.encode()[-1]]
        assert model.merge_long(symbols).tolist() == model.merge_words([word])[0].tolist()


def test_junk_and_the_lattice():
    assert [toxicity.without_junk(c) for c in ("===a", "a===", "==a==", "a", "", "!!!!", "---a-b***", "aaa", "___a")] == ["a", "a", "==a==", "a", "", "", "a-b", "aaa", "___a"]
    restorer = toxicity.Restorer(np.full((toxicity.LETTERS,) * 3, 3.0).tolist())
    word = "st0p"
    assert restorer.restore(word * 1200) == "".join(restorer.restore(word) for _ in range(1200))


def test_words_left_out_carry_no_weight():
    rng = random.Random(8)
    costs = rng.choices([1.0, 2.0, 3.0, 6.0], k=toxicity.LETTERS**3)
    restorer = toxicity.Restorer(np.array(costs).reshape((toxicity.LETTERS,) * 3).tolist())
    weights = {"=idiot": 2.0, "scum": 1.0, "=ass": 0.5, "losin": 3.0}
    scorer = toxicity.Scorer(restorer.costs, weights)
    bits = ["idiot", "1d!0t", "sc", "um", "mm", "(", "|", "l0s", "in", "g", "a", "ss", "5", "é", "-", "...", "!", "xx", "7"]
    for _ in range(3000):
        chunk = "".join(rng.choices(bits, k=rng.randint(1, 6)))
        for own in (chunk, chunk + ".", chunk + "!", chunk + "|"):
            want = scorer.weight(restorer.words(own))
            assert scorer.weight(restorer.words(own, scorer.tree)) == scorer.chunk_weight(own) == want, own


def test_the_quick_look_for_spaced_words_misses_none():
    rng = random.Random(9)
    for _ in range(20_000):
        text = "".join(rng.choices(["a", "é", "b", " ", "  ", ".", "-", "_", "*", "@", "!", ",", "中", "7", "word", " s c u m "], k=rng.randint(1, 12)))
        text = " ".join(text.split())
        kinds = text.encode("utf-8", "replace").translate(toxicity._KINDS, toxicity._CONTINUED)
        if toxicity.MAYBE_SPACED.search(text):
            assert b"_" in kinds or any(g in kinds for g in toxicity._GAPPED), text


def test_numbers_of_any_length():
    text = "Licensed under the Apache License, " + "9" * 5000 + " Version 2.0."
    assert isinstance(find_licenses(text), list)
    assert [m.license for m in find_licenses("Licensed under the MIT License. " + "0" * 6000)] == ["MIT"]


@pytest.mark.parametrize("inserted", [8, 9, 12, 25, 40])
def test_notices_with_words_put_in(inserted):
    name, notice = max(TEMPLATES, key=lambda t: len(t[1].split()))
    words = notice.split()
    other = [f"word{chr(97 + k % 26)}x" for k in range(inserted)]
    for at in (12, len(words) // 2, len(words) - 12):
        text = " ".join(["Some", "text."] + words[:at] + other + words[at:] + ["And", "more."])
        (m,) = find_licenses(text)
        assert m.license == name and m.coverage > 0.95 and text[m.start :].startswith(words[0])


def test_parts_that_are_far_apart_are_no_notice():
    _, notice = max(TEMPLATES, key=lambda t: len(t[1].split()))
    words, half = notice.split(), len(notice.split()) // 2
    assert find_licenses(" ".join(words[:half] + ["other"] * 300 + words[half:])) == []


def test_chained_takes_the_longest_rising_chain():
    rng = random.Random(6)
    for _ in range(300):
        pairs = sorted({(rng.randint(0, 6), rng.randint(0, 12)) for _ in range(rng.randint(1, 9))})
        gap = rng.choice([2, 20])
        best = 0
        for k in range(1, len(pairs) + 1):
            for some in itertools.combinations(pairs, k):
                if all(a[0] < b[0] and a[1] < b[1] <= a[1] + gap + 1 for a, b in itertools.pairwise(some)):
                    best = max(best, k)
        got = chained([pairs], gap)
        assert got == sorted(set(got)) and len(got) <= best
        assert len(got) == best or gap == 2  # with a narrow gap the longest chain to a place may be out of reach


def plain_bits(value):
    """Cheapest segmentation by trying every segment between every two cuts."""
    n, lower = len(value), value.lower()
    plain = lower.translate(secret_scan.PLAIN_LETTER)
    ranks = {w: k for k, w in enumerate(COMMON_WORDS, 1)}
    rows = secret_scan.KEYBOARD_ROWS
    beside = {(a, b) for row in rows for a, b in zip(row, row[1:], strict=False)}
    best = [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        for i in range(j):
            part, costs = value[i:j], [sum(map(secret_scan._char_bits, value[i:j]))]
            rank, swapped = ranks.get(lower[i:j]), 0.0
            if rank is None:
                rank, swapped = ranks.get(plain[i:j]), 2.0
            if rank:
                upper = sum(c.isupper() for c in part)
                costs.append(math.log2(rank + 1) + swapped + (0 if not upper else 1 if upper == len(part) or part[0].isupper() and upper == 1 else upper))
            if part[0].isdigit() and len(part) in DATE_BITS and DATE.fullmatch(part):
                costs.append(DATE_BITS[len(part)])
            for p in (1, 2, 3):
                if len(part) >= max(3, 2 * p) and all(part[k] == part[k + p] for k in range(len(part) - p)):
                    costs.append(sum(map(secret_scan._char_bits, part[:p])) + math.log2(len(part) / p))
            steps = list(zip(lower[i:j], lower[i + 1 : j], strict=False))
            if len(part) >= 3 and (all(s in beside for s in steps) or all(s[::-1] in beside for s in steps)):
                costs.append(6.0 + math.log2(len(part)))
            best[j] = min(best[j], best[i] + SEGMENT_BITS + min(costs))
    return best[n]


def test_guess_cost_is_the_minimum_over_all_kinds_of_segments():
    rng = random.Random(3)
    bits = ["shadow", "love", "qwerty", "tyuiop", "1234", "aaa", "abab", "xyzxyz", "1999", "19991231", "12-05-2001", "K", "z", "#", "7", "sun", "p@ss", "Moon", "rewq", "987"]
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))
        assert guess_bits(value) == pytest.approx(plain_bits(value)), value
    for value in ("shadowertyuiop1", "a" * 90, "ab" * 40 + "love", "x" + "qwertyuiop" * 5, "1" * 37 + "password"):
        assert guess_bits(value) == pytest.approx(plain_bits(value)), value
    assert guess_bits("shadowertyuiop1") < MIN_GUESS_BITS


@pytest.mark.parametrize(
    "text",
    [
        r'pwd: "xK9#m\"Q2$vL7p"', 'pwd: "xK9#mQ2$vL7p\nnext line', "passphrase='xK9#mQ2$vL7p", "<password>xK9#mQ2$vL7p</password>",
        "<db-password>xK9#mQ2$vL7p</db-password>", "DB_PASS=xK9#mQ2$vL7p", "PASS: xK9#mQ2$vL7p", "<pass>xK9#mQ2$vL7p</pass>",
    ],
)
def test_values_in_further_contexts_are_masked_whole(text):
    out = masked_text(text, find_spans(text, MIN_GUESS_BITS)[1], "*")
    assert "*" in out and "xK9" not in out and "L7p" not in out and "Q2" not in out


@pytest.mark.parametrize("text", ["a pass is authentication-free", "compass: magnificently", "<token> embeddings", "the <password> placeholder", "pass: ok"])
def test_prose_is_left_alone(text):
    assert find_spans(text, MIN_GUESS_BITS)[1] == []


def test_cut_indexes_and_trailing_bytes_are_noticed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(40)], "doc_id long, text string")
    manifest = write_records(docs, vocabulary_path(), str(tmp_path / "records")).cache()
    assert read_records(manifest).count() == 40
    row = max(manifest.collect(), key=lambda r: r.n_records)
    path = row.path.removeprefix("file://")
    index, records = open(f"{path}.idx", "rb").read(), open(f"{path}.rec", "rb").read()

    def read():
        return list(read_shard(row.path, row.n_records, row.n_ids))

    for broken in (index[:-28] + index[-4:], index[:-28], index[:-1], b"", index[24:]):
        open(f"{path}.idx", "wb").write(broken)
        with pytest.raises(ValueError, match="index"):
            read()
    open(f"{path}.idx", "wb").write(index)
    open(f"{path}.rec", "wb").write(records + b"\0")
    with pytest.raises(ValueError, match="after the last record"):
        read()
    open(f"{path}.rec", "wb").write(records)
    assert len(read()) == row.n_records
    with pytest.raises(ValueError, match="manifest"):
        list(read_shard(row.path, row.n_records, row.n_ids + 1))


def test_rows_without_an_id_are_spread_over_shards(spark, tmp_path):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i}") for i in range(600)]
    manifest = write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), vocabulary_path(), str(tmp_path / "records")).cache()
    sizes = [r.n_records for r in manifest.collect()]
    assert sum(sizes) == 600 and max(sizes) < 200
    out = sorted(read_records(manifest).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()


@pytest.mark.parametrize("kind", ["int", "string"])
def test_vectors_of_any_length_link_by_their_direction(spark, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6))
    x[30:] = x[:30] + rng.normal(size=(30, 6)) * 0.15
    norms = 10.0 ** rng.integers(-200, 200, 60)
    label = [("a" if i % 2 else "b") if kind == "string" else i % 2 for i in range(60)]
    rows = [(i, (x[i] * norms[i]).tolist(), label[i]) for i in range(60)] + [(100, [1e-200] + [0.0] * 5, label[0]), (101, [2e-200] + [0.0] * 5, label[0])]
    unit = np.vstack([x / np.linalg.norm(x, axis=1)[:, None], [[1, 0, 0, 0, 0, 0]] * 2])
    link = (unit @ unit.T >= 0.93) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}"), 0.93).collect()}
    assert got == {r[0]: int(n) - 1 for r, n in zip(rows, link.sum(axis=1), strict=True)}


def test_links_of_a_tight_group_grow_with_its_rows():
    rng = np.random.default_rng(2)
    x = np.array([1.0] + [0.0] * 7) + rng.normal(size=(900, 8)) * 0.005
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cells = 40
    pivots = {0: (np.arange(cells), np.arange(cells), unit[:cells], np.full(cells, 0.02), np.full(cells, 5, np.int64)), None: True}
    arrays = [pa.array(np.zeros(900, np.int64)), pa.array(np.arange(900)), pa.array(np.ones(900, np.int64)), pa.array(x.tolist())]
    batch = pa.RecordBatch.from_arrays(arrays, ["label", "rep", "weight", "vector"])
    out = pa.Table.from_batches(list(_visits(8, np.sqrt(2 - 2 * 0.93), SimpleNamespace(value=pivots))([batch]))).to_pandas()
    links = out[out.vector.isna()]
    assert len(links) <= 900 + 2 * cells
    assert links[links.gain > 0].groupby("rep").gain.sum().to_dict() == {i: 5 * (cells - 1) for i in range(900)}
    # every row is linked with a pivot, and the pivots among each other
    label = list(range(cells))
    for a, b in links[links.gain == 0][["rep", "pivot"]].itertuples(index=False):
        label = [label[a] if m == label[b] else m for m in label]
    assert len(set(label)) == 1
