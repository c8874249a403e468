"""Operators 2, 4 and 9 against the tokenizers library."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from returnsight.llm.bpe import WordBpe, encode_decode
from returnsight.llm.packing import best_fit_packing, plan
from returnsight.llm.records import MASK_DELTA, fetch, frame, masked, read_records, token_records, unframe, write_records
from returnsight.llm.tokens import LibraryChunks, sliced_ids, vocabulary_path

ALPHABET = list("aAbBtTsS'’ΣςéÉêß \n\t\x1c\x1f\x85\xa0 　́​İıŁæ漢字한글ㄱ1२½$%_-<|>🙂🏽 \x00�٣ǅﬁ") + ["<|endoftext|>", "'ll", "'s", "aaaa"]
SCHEMA = "doc_id long, text string, part string, rank string, of_part int, length string, key string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def random_texts(n):
    rng = random.Random(3)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def edge_docs(spark):
    """Null and empty texts, a very long one, exact copies, repeated and null ids, clashing columns."""
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "Twice, twice!"), (5, "Twice, twice!"), (5, "Twice, twice!"), (None, "no id"), (7, "x" * 6000), (8, " \n "), (9, "<|endoftext|> mid")]
    rows += [(100 + k, t) for k, t in enumerate(random_texts(300))]
    return spark.createDataFrame([(i, t, "a", "b", 1, "c", "d") for i, t in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("kind", [LibraryChunks, WordBpe])
def test_ids_equal_the_library(kind, library):
    texts = random_texts(4000) + ["", "a" * 3000, "Ab1 " * 2000]
    encoder = kind(vocabulary_path(), limit=500)  # a small table, so that it is emptied
    encoder.encode(pa.array(["Some words before", ""]))
    for lo, ids, ends in sliced_ids(encoder, pa.array(texts)):
        for k in range(len(ends) - 1):
            want = library.encode(texts[lo + k], add_special_tokens=False).ids
            own = ids[ends[k] : ends[k + 1]]
            assert own.tolist() == want, texts[lo + k]
            if kind is WordBpe:
                assert encoder.decode(own).decode() == library.decode(want, skip_special_tokens=False)


def test_encode_decode_edges(spark, library):
    docs = edge_docs(spark)
    got = encode_decode(docs, vocabulary_path(), with_ids=True).collect()
    assert len(got) == docs.count()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in got:
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert r.ids == want and r.n_tokens == len(want) and r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert encode_decode(docs.limit(0), vocabulary_path()).collect() == []


def test_records_edges(spark, library):
    docs = edge_docs(spark)
    got = sorted(token_records(docs, vocabulary_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i))
    texts, start = {r.doc_id: r.text or "" for r in docs.collect()}, 0
    for r in got:
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_records(docs.limit(0), vocabulary_path()).collect() == []


def test_shuffled_read_and_damage(spark, library, tmp_path):
    docs = edge_docs(spark)
    manifest = write_records(docs, vocabulary_path(), str(tmp_path))
    shard = max(manifest.collect(), key=lambda r: r.n_records)
    for k in (shard.n_records - 1, 0):
        doc_id, ids = fetch(shard.path, k)
        text = docs.where(docs.doc_id.eqNullSafe(doc_id)).first().text or ""
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
    path = f"{shard.path}.rec"
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        read_records(manifest).collect()


def test_frame_layout():
    data = frame(b"abc")
    crc = zlib.crc32(b"abc")
    assert data[:8] == struct.pack("<Q", 3) and data[12:15] == b"abc"
    assert struct.unpack("<I", data[15:])[0] == masked(b"abc") == (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF
    assert unframe(frame(b"") + data, 16) == (b"abc", 16 + len(data))
    for cut in (0, 5, 14, len(data) - 1):
        with pytest.raises(ValueError):
            unframe(data[:cut])


def placed(counts, capacity):
    """Item by item: {sequence: [(offset, length)]}."""
    runs, out = plan(counts, capacity), {}
    for k, run in enumerate(runs):
        end = runs[k + 1].rank if k + 1 < len(runs) and runs[k + 1].length == run.length else counts[run.length]
        for at in range(end - run.rank):
            out.setdefault(run.sequence + at // run.each, []).append((run.offset + at % run.each * run.length, run.length))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_gapless_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 30, 100])
    counts = {k: rng.randint(0, rng.choice([1, 3, 400])) for k in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
    sequences = placed(counts, capacity)
    assert sum(map(len, sequences.values())) == sum(counts.values())
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    # never more than best-fit item by item, longest first
    bins: list[int] = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        if room := [g for g in bins if g >= length]:
            bins.remove(min(room))
            bins.append(min(room) - length)
        else:
            bins.append(capacity - length)
    assert len(sequences) <= len(bins) * 1.03 + 1


def test_packing_edges(spark, library):
    docs = edge_docs(spark)
    got = best_fit_packing(docs, vocabulary_path(), capacity=64).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    order = lambda row: (row[0] is None, row[0] or 0, *row[1:])
    assert sorted([tuple(r)[:5] for r in got], key=order) == sorted(want, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in sequences.values():
        ends = [o + n for o, n in sorted(items)]
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(sequences) <= sum(w[3] for w in want) / 64 * 1.03 + 1
    assert best_fit_packing(docs.limit(0), vocabulary_path()).collect() == []
