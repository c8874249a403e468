"""Byte-pair encoding and decoding by batched array merges.

All words new to a worker are merged together: their symbols lie in one flat array, every round
looks up all neighbouring pairs by binary search over the sorted pair keys, takes each word's lowest
rank and merges that pair wherever it occurs in the word. A word longer than ``LONG`` bytes, whose
rounds would be many, is merged alone: its pairs lie in one queue by rank, and a round looks up only
the pairs beside its merges. The vocabulary file gives the symbols and the ranked merges; normalisation (NFC, white space, lower case) and the split into words follow it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.llm.common import gathered, ready
from returnsight.llm.tokens import ChunkTable, byte_letters, sliced_ids, worker_table

NO_RANK = np.iinfo(np.int64).max
#: Bytes up to which words are merged together.
LONG = 256


class WordBpe(ChunkTable):
    def __init__(self, path: str, **kw):
        super().__init__(**kw)
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_rx = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.word_rx = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(max(vocab.values()), *self.special.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        self.key_of = keys  # by rank
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        names = [""] * self.base
        for token, i in (vocab | self.special).items():
            names[i] = token
        spelled = [(n + " ").encode() for n in names]
        self.text_starts = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        self.text = np.frombuffer(b"".join(spelled), np.uint8)

    def normalise(self, chunk: str) -> str:
        if chunk.isascii():
            return chunk.lower()
        # letter by letter: the tokenizer's lower case knows no final sigma
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk; a special token, marked by a leading NUL, stands alone."""
        if self.special_rx and "<|" in chunk and (parts := self.special_rx.split(chunk))[1:]:
            return [w for p in parts for w in (["\0" + p] if p in self.special else self.word_rx.findall(self.normalise(p)))]
        return self.word_rx.findall(self.normalise(chunk))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, starts = self.merge_words(words)
        return ids.astype(np.uint32), np.diff(starts)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, their starts and the end)."""
        special = {k: self.special[w[1:]] for k, w in enumerate(words) if w[0] == "\0" and w[1:] in self.special}
        data = [b"\0" if k in special else w.encode() for k, w in enumerate(words)]
        size = np.fromiter(map(len, data), np.int64, len(data))
        symbols = self.inner[np.frombuffer(b"".join(data), np.uint8)]
        word = np.repeat(np.arange(len(words)), size)
        if len(words):
            symbols[np.cumsum(size) - 1] = self.last[[d[-1] for d in data]]
        done_ids: list[np.ndarray] = []
        done_words: list[np.ndarray] = []
        if len(words) and size.max() > LONG:
            ends = np.cumsum(size)
            for k in np.flatnonzero(size > LONG).tolist():
                done_ids.append(self.merge_long(symbols[ends[k] - size[k] : ends[k]]))
                done_words.append(np.full(len(done_ids[-1]), k))
            short = np.repeat(size <= LONG, size)
            symbols, word = symbols[short], word[short]
        while len(symbols):
            rank = np.where(word[:-1] == word[1:], self.pair_ranks(symbols[:-1], symbols[1:]), NO_RANK)
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = lowest == NO_RANK
            done_ids.append(symbols[over])
            done_words.append(word[over])
            symbols, word, rank, lowest = symbols[~over], word[~over], rank[~over], lowest[~over]
            hit = rank == lowest
            place = np.flatnonzero(hit)
            if len(place):  # of pairs that overlap, as in "aaa", the first, third, ... are merged
                fresh = np.concatenate([[True], np.diff(place) != 1])
                run = np.arange(len(place)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
                place = place[run % 2 == 0]
                symbols[place] = self.merged[rank[place]]
                keep = np.ones(len(symbols), bool)
                keep[place + 1] = False
                symbols, word = symbols[keep], word[keep]
        ids = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
        owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids = ids[order]
        for k, i in special.items():
            ids[np.searchsorted(owner[order], k)] = i
        return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one word: its pairs wait by rank, each as the place of its left symbol, and symbols
        are linked to their neighbours."""
        symbols, n = symbols.copy(), len(symbols)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def wait(places: np.ndarray) -> None:
            rank = self.pair_ranks(symbols[places], symbols[after[places]])
            places, rank = places[rank != NO_RANK], rank[rank != NO_RANK]
            order = np.argsort(rank, kind="stable")
            values, first = np.unique(rank[order], return_index=True)
            for r, own in zip(values.tolist(), np.split(places[order], first[1:]), strict=False):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(own)

        wait(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            place = np.unique(np.concatenate(waiting.pop(r)))
            place = place[alive[place] & (after[place] < n)]
            # what has not changed since it came into the queue
            place = place[symbols[place] * self.base + symbols[after[place]] == self.key_of[r]]
            if not len(place):
                continue
            # of pairs that overlap, as in "aaa", the first, third, ... are merged
            fresh = np.concatenate([[True], after[place[:-1]] != place[1:]])
            run = np.arange(len(place)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            place = place[run % 2 == 0]
            gone = after[place]
            symbols[place] = self.merged[r]
            alive[gone] = False
            after[place] = after[gone]
            follows = after[place] < n
            before[after[place[follows]]] = place[follows]
            left = before[place]
            beside = np.unique(np.concatenate([left[left >= 0], place[follows]]))
            wait(beside)
        return symbols[alive]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens with a space between them, in UTF-8: the file has no decoder that would join them."""
        size = self.text_starts[ids.astype(np.int64) + 1] - self.text_starts[ids]
        before = np.cumsum(size) - size
        at = np.repeat(self.text_starts[ids] - before, size) + np.arange(int(size.sum()))
        return self.text[at].tobytes()[:-1]


FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs`` (doc_id, text), with
    ``with_ids`` also the ids and the decoded text. Null texts count as empty (no ids); null or
    repeated ids are kept as they are; an empty table gives no rows; other columns are ignored."""

    def roundtrip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_table(WordBpe, vocabulary)
        for batch in gathered(batches, text=1):
            for first, ids, ends in sliced_ids(model, batch.column(1)):
                ids, ends, rows = ids.astype("<u4", copy=False), ends.tolist(), []
                for lo, hi in zip(ends, ends[1:], strict=False):
                    decoded = model.decode(ids[lo:hi])
                    row = hi - lo, hashlib.sha256(ids[lo:hi]).hexdigest(), hashlib.sha256(decoded).hexdigest()
                    rows.append((*row, ids[lo:hi].astype("int32"), decoded.decode()) if with_ids else row)
                columns = [batch.column(0)[first : first + len(rows)], *(pa.array(c) for c in zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    rows = ready(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(roundtrip, FIELDS + ", ids array<int>, decoded string" * with_ids)
