"""Token ids of whole texts, by distinct chunk and word.

The tokenizer drops white space and never joins across it, so a text's ids are the ids of its
chunks in order. Arrow splits the texts and finds the distinct chunks of a slice; most are a plain
word, perhaps with a punctuation mark, whose ids are those of the lower-case word and the mark. Each
worker keeps the ids of the words it has met (a bounded table), so only new words are encoded."""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from returnsight.llm.common import slices

def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself if printable in Latin-1, else the next free code from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class IdTable:
    """Ids by string, with how often each was asked for. Of a full table the half asked for most
    often stays."""

    def __init__(self, limit: int):
        self.limit = limit
        self._fill([], np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _fill(self, keys: list[str], ids: np.ndarray, lens: np.ndarray, hits: np.ndarray) -> None:
        self.codes = dict(zip(keys, range(len(keys)), strict=True))
        self.ids, self.used = ids, len(ids)
        self.starts = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        self.hits = hits

    def make_room(self, n: int) -> bool:
        """Whether entries were removed, so that codes are new."""
        if len(self.codes) <= self.limit // 2 or len(self.codes) + n <= self.limit:
            return False
        keep = np.sort(np.argsort(-self.hits, kind="stable")[: self.limit // 2])
        keys = list(self.codes)
        ids, lens = self.gather(keep)
        self._fill([keys[k] for k in keep], ids, lens, self.hits[keep])
        return True

    def add(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, m = len(self.codes), len(keys)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.uint32)])
        if n + m >= len(self.starts):
            self.starts = np.concatenate([self.starts[: n + 1], np.zeros(n + 2 * m, np.int64)])
            self.hits = np.concatenate([self.hits[:n], np.zeros(n + 2 * m, np.int64)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n + 1 : n + m + 1] = self.used + np.cumsum(lens)
        self.used += len(ids)
        self.codes.update(zip(keys, range(n, n + m), strict=True))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of ``codes`` in a row, number of ids of each)."""
        first, lens = self.starts[codes], self.starts[codes + 1] - self.starts[codes]
        return self.ids[np.repeat(first - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))], lens

    def lookup(self, keys: list[str], encode) -> np.ndarray:
        """Code of every key; ``encode`` gives (ids, lengths) of those not in the table."""
        codes = np.fromiter(map(self.codes.get, keys, repeat(-1)), np.int64, len(keys))
        if len(new := np.flatnonzero(codes < 0)):
            missing = list(dict.fromkeys(map(keys.__getitem__, new.tolist())))
            if self.make_room(len(missing)):
                return self.lookup(keys, encode)
            self.add(missing, *encode(missing))
            codes[new] = np.fromiter((self.codes[keys[k]] for k in new.tolist()), np.int64, len(new))
        used = np.bincount(codes)
        self.hits[: len(used)] += used
        return codes


class ChunkTable:
    """Ids of texts from those of their distinct chunks, and these from those of their words;
    ``encode_words`` supplies the ids of words not met before."""

    #: Letters whose lower case and composition do not depend on their neighbours.
    PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
    MARKS = ".,;:!?"

    def __init__(self, limit: int = 400_000):
        self.words = IdTable(limit)

    def split(self, chunk: str) -> list[str]:
        """Words of a chunk that is not plain; the tokenizer must never join them."""
        return [chunk]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each)."""
        raise NotImplementedError

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct chunks in a row, number of ids of each)."""
        core = pc.ascii_rtrim(chunks, self.MARKS)
        cut = _numpy(pc.subtract(pc.binary_length(chunks), pc.binary_length(core)))
        plain = _numpy(pc.match_substring_regex(core, self.PLAIN)) & (cut <= 1)
        lower = pc.utf8_lower(core.filter(pa.array(plain))).dictionary_encode()
        words = [*lower.dictionary.to_numpy(zero_copy_only=False), *self.MARKS]
        base = len(words)
        other = [self.split(c) for c in chunks.filter(pa.array(~plain)).to_numpy(zero_copy_only=False)]
        codes = self.words.lookup([*words, *chain.from_iterable(other)], self.encode_words)

        parts = np.ones(len(chunks), np.int64)
        parts[~plain] = np.fromiter(map(len, other), np.int64, len(other))
        marked = np.flatnonzero(plain & (cut == 1))
        parts[marked] = 2
        ends = np.cumsum(parts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        rest = np.repeat(~plain, parts)
        flat[rest] = codes[base:]
        flat[(ends - parts)[plain]] = codes[lower.indices.to_numpy(zero_copy_only=False)]
        mark = pc.utf8_slice_codeunits(chunks.take(pa.array(marked)), -1)
        flat[ends[marked] - 1] = codes[base - len(self.MARKS) + _numpy(pc.index_in(mark, pa.array(list(self.MARKS))))]
        ids, lens = self.words.gather(flat)
        return ids, np.diff(np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], ends])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); ``texts`` holds no nulls."""
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.flatten().dictionary_encode()
        ids, lens = self._distinct(coded.dictionary)
        code = coded.indices.to_numpy(zero_copy_only=False)
        size = lens[code]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat((np.cumsum(lens) - lens)[code] - before[:-1], size) + np.arange(before[-1])
        ends = np.concatenate([[0], np.cumsum(_numpy(pc.list_value_length(chunks)))])
        return ids[at], np.diff(before[ends])


def _numpy(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False)


class LibraryChunks(ChunkTable):
    """The ``tokenizers`` library, without special tokens, truncation or padding."""

    def __init__(self, path: str, **kw):
        super().__init__(**kw)
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = dict(enumerate(byte_letters()))
        self.plain_rx = re.compile(self.PLAIN)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # lower-case plain letters need no normalising and are one word: straight to the model, spelled as bytes
        plain = [w.islower() and self.plain_rx.fullmatch(w) is not None for w in words]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False))
        tokenize = self.tokenizer.model.tokenize
        spelled = (w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words)
        found = [[t.id for t in tokenize(s)] if p else next(rest).ids for s, p in zip(spelled, plain, strict=True)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lens.sum())), lens


_tables: dict[tuple, ChunkTable] = {}


def worker_table(kind: type[ChunkTable], path: str) -> ChunkTable:
    """This Python worker's table for a vocabulary file (kept between its tasks)."""
    if (kind, path) not in _tables:
        _tables[kind, path] = kind(path)
    return _tables[kind, path]


def sliced_ids(encoder: ChunkTable, texts: pa.Array, end_id: int | None = None):
    """(index of the first text, ids, offsets) per slice of ``texts`` (null: empty); text k of the
    slice owns ids[offsets[k]:offsets[k + 1]], with ``end_id`` last if given."""
    texts = pc.fill_null(texts, "")
    for lo, hi in slices(_numpy(pc.binary_length(texts)).tolist()):
        ids, lens = encoder.encode(texts[lo:hi])
        if end_id is not None:
            ids, lens = np.insert(ids, np.cumsum(lens), end_id), lens + 1
        yield lo, ids, np.concatenate([[0], np.cumsum(lens)])
