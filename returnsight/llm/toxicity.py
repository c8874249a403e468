"""Toxicity of texts whose wording may be disguised.

A disguised word ("1d!0t", "s t u p i d", "claaase") is read as a noisy channel's output: every
written character could stand for a few letters, be a filler between letters, or repeat the letter
before. These possibilities form a lattice, and Viterbi decoding finds the reading of least cost
under a character trigram model counted over the whole corpus. The restored words are then scored:
words and word beginnings whose share of toxic texts is far above the average carry log-odds
weights, and a logistic regression over a text's weights gives the probability.

The character counts cover all documents (a table of 28^3 entries at most, summed inside tasks
first). Weights and regression are fitted on at most ``FIT_ROWS`` labelled rows outside the held-out
third, taken in hash order of the id."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm import logistic
from returnsight.llm.common import fit_sample, held_out, ready, slices, staged

#: At most so many labelled rows are used for fitting.
FIT_ROWS = 20_000
#: A text is called toxic from this score on.
THRESHOLD = 0.7

# What a written character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
# Cost in nats of a substitution, of a filler left out, of a word end at a filler or at a
# character that may stand for a letter, of such a character at a chunk's edge read as punctuation, of a
# repeat left out of three or more, of one of two (the letter model keeps most ordinary doubles).
SUBSTITUTE, FILLER, WORD_END, SIGN_END, EDGE_END, REPEAT, DOUBLE = 1.0, 0.7, 2.0, 12.0, 8.0, 0.5, 3.0

LETTERS = 28  # 0: no letter, 1-26: a-z, 27: any other letter
WORD = re.compile(r"[^\W\d_]+")
EDGES = ".,;:?\"'()[]{}<>*&%#~^`“”«»¿¡…-_/=+|\\"
#: Those that stand for no letter.
PLAIN_EDGES = "".join(c for c in EDGES if c not in STANDS_FOR)
DOUBLED = re.compile(r"([^\W\d_])\1")
# A quick look for what SPACED may find, wherever a word may begin.
_KINDS = bytes(ord("a") if chr(b).isalnum() or b >= 128 or chr(b) in "@$!|+" else ord(" ") if chr(b) in " .-*~" else ord("_") if b == ord("_") else ord(",") for b in range(256))
_CONTINUED = bytes(range(128, 192))
# The same without regard to what stands before: one character, one or two gaps, three times. A _ may be either.
_GAPPED = tuple(f"a{x}a{y}a ".encode() for x in (" ", "  ") for y in (" ", "  "))
MAYBE_SPACED = re.compile(r"(?<![^\W_])(?:[\w@$!|+][ .\-_*~]{1,2}){3}")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$!|+])){3,}(?![^\W_])")
#: Characters that the lattice decodes together: of a longer string the reading up to there is settled.
LATTICE = 2_000


# Lengths of the word beginnings that carry weights.
SHORTEST_HEAD, LONGEST_HEAD = 4, 6


def without_junk(chunk: str) -> str:
    """``chunk`` without a run of three or more of the same sign at its beginning and at its end."""
    for strip, first in ((str.lstrip, 0), (str.rstrip, -1)):
        if chunk and not chunk[first].isalnum() and chunk[first] != "_":
            rest = strip(chunk, chunk[first])
            if len(chunk) - len(rest) >= 3:
                chunk = rest
    return chunk


def letter_codes() -> np.ndarray:
    """Symbol of every byte of a lower-case text in UTF-8."""
    codes = np.zeros(256, np.uint8)
    codes[ord("a") : ord("z") + 1] = np.arange(1, 27)
    codes[128:] = 27
    return codes


def trigram_counts(texts: list[str]) -> np.ndarray:
    codes = letter_codes()[np.frombuffer("\n".join(["", *texts, ""]).lower().encode("utf-8", "replace"), np.uint8)]
    codes = codes[np.concatenate([[True], (codes[1:] > 0) | (codes[:-1] > 0)])].astype(np.uint16)  # one gap between words
    return np.bincount(codes[:-2] * LETTERS**2 + codes[1:-1] * LETTERS + codes[2:], minlength=LETTERS**3)


def character_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; tasks sum first, and 28^3 sums at most reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for lo, hi in slices([len(t) for t in texts]):
                total += trigram_counts(texts[lo:hi])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    rows = ready(docs).select(F.col("text").cast("string").alias("text")).mapInArrow(count, "gram long, n long")
    out = np.zeros(LETTERS**3, np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def trigram_costs(counts: np.ndarray) -> list:
    """-log P(c | a, b), backing off to pairs and single symbols; [a][b][c]."""
    n = counts.reshape(LETTERS, LETTERS, LETTERS).astype(float)
    single = (n.sum(axis=(0, 1)) + 1) / (n.sum() + LETTERS)
    pair = (n.sum(axis=0) + 5 * single) / (n.sum(axis=(0, 2))[:, None] + 5)
    triple = (n + 5 * pair[None]) / (n.sum(axis=2)[:, :, None] + 5)
    return (-np.log(triple)).tolist()


def head_tree(heads: set[str]) -> dict:
    """Letter by letter, nested; None marks the end of a beginning."""
    tree: dict = {}
    for head in heads:
        node = tree
        for c in head:
            node = node.setdefault(c, {})
        node[None] = {}
    return tree


def may_begin(raw: str, tree: dict) -> bool:
    """Whether some reading of ``raw``, of whatever cost, has a word that starts with one of the
    beginnings in ``tree``. Most strings have none after a letter or two, which spares their lattice."""
    nodes, before, start, plain = [], "", True, raw.isalpha()
    for c in raw:
        letters = c if "a" <= c <= "z" else STANDS_FOR.get(c) or (c if c.isalpha() else "")
        if start:
            nodes.append(tree)
        kept = nodes if c == before or not letters else []  # left out: a repeat or a filler
        nodes = kept + [node[x] for node in nodes for x in letters if x in node]
        if any(None in node for node in nodes):
            return True
        if plain and not nodes:
            return False
        before, start = c, not letters or c in STANDS_FOR  # which may end a word
        if len(nodes) > 64:
            nodes = list({id(node): node for node in nodes}.values())
    return False


class Restorer:
    def __init__(self, costs: list):
        self.costs = costs

    def options(self, raw: str, k: int, sign_end: float = SIGN_END) -> list[tuple[int, str, float]]:
        """(symbol, letter, cost) readings of character k: -1 leaves it out, 0 ends the word."""
        c = raw[k]
        if "a" <= c <= "z":
            out = [(ord(c) - 96, c, 0.0)]
        elif c in STANDS_FOR:
            out = [(ord(x) - 96, x, SUBSTITUTE) for x in STANDS_FOR[c]] + [(0, " ", sign_end)]
        elif c.isalpha():
            out = [(27, c, 0.0)]
        else:
            return [(-1, "", FILLER), (0, " ", WORD_END)]
        if k and raw[k - 1] == c:
            thrice = c in (raw[k - 2 : k - 1], raw[k + 1 : k + 2])
            out.append((-1, "", REPEAT if thrice else DOUBLE))
        return out

    def restore(self, raw: str, core: tuple[int, int] | None = None) -> str:
        """The reading of least cost of a lower-case string, words parted by spaces. Signs outside
        ``core`` (a range of positions, default: all) may well be punctuation. After every ``LATTICE``
        characters the cheapest reading so far is settled, which bounds the lattice."""
        start, end = core or (0, len(raw))
        state, out = (0, 0), []
        for lo in range(0, len(raw), LATTICE):
            states: dict[tuple[int, int], float] = {state: 0.0}
            trail: list[dict] = []
            hi = min(lo + LATTICE, len(raw))
            for k in range(lo, hi):
                options = self.options(raw, k, SIGN_END if start <= k < end else EDGE_END)
                best: dict[tuple[int, int], float] = {}
                back: dict[tuple[int, int], tuple] = {}
                for (a, b), cost in states.items():
                    row = self.costs[a][b]
                    for symbol, letter, price in options:
                        if symbol < 0 or (symbol == 0 and b == 0):
                            to, total, letter_out = (a, b), cost + price, ""
                        else:
                            to, total, letter_out = (b, symbol), cost + price + row[symbol], letter
                        if to not in best or total < best[to]:
                            best[to], back[to] = total, ((a, b), letter_out)
                states = best
                trail.append(back)
            last = hi == len(raw)
            at = state = min(states, key=lambda s: states[s] + (self.costs[s[0]][s[1]][0] if s[1] and last else 0.0))
            part = []
            for back in reversed(trail):
                at, letter = back[at]
                part.append(letter)
            out += reversed(part)
        return "".join(out).strip()

    def words(self, chunk: str, heads: dict | None = None) -> list[str]:
        """Words of a lower-case chunk without white space, disguised ones restored. With ``heads`` (as
        ``head_tree`` makes it) what cannot be read as a word with one of these beginnings may be left
        out."""
        if chunk.isalpha() and not DOUBLED.search(chunk):
            return [chunk]
        chunk = without_junk(chunk)
        core = chunk.strip(EDGES).rstrip("!").strip(EDGES)
        whole = chunk.strip(PLAIN_EDGES)  # with the signs at its edges that may be letters
        out = WORD.findall(core)
        if core and (not core.isalpha() or DOUBLED.search(core)) and (heads is None or may_begin(core, heads)):
            out += self.restore(core).split()
        if whole != core and (heads is None or may_begin(whole, heads)):
            at = len(whole) - len(whole.lstrip(EDGES))
            out += self.restore(whole, (at, at + len(core))).split()
        return out

    def spaced(self, text: str) -> list[str]:
        """What a lower-case text has written letter by letter, from each letter on: the gaps do not
        tell where a word begins."""
        text = " ".join(text.split())  # gaps may be wide, or line ends
        kinds = text.encode("utf-8", "replace").translate(_KINDS, _CONTINUED)
        if b"_" not in kinds and not any(g in kinds for g in _GAPPED) or not MAYBE_SPACED.search(text):
            return []
        read = (self.restore(m[0]).replace(" ", "") for m in SPACED.finditer(text))
        return [r[k : k + LONGEST_HEAD] for r in read for k in range(len(r) - SHORTEST_HEAD + 1)]


def features(word: str) -> list[str]:
    """The word, and its beginnings, which inflected forms share."""
    return ["=" + word, *(word[:k] for k in range(SHORTEST_HEAD, LONGEST_HEAD + 1) if len(word) >= k)]


class Scorer:
    """Word weights of texts; keeps a bounded table of chunks it has met."""

    def __init__(self, costs: list, weights: dict[str, float], limit: int = 200_000):
        self.restorer, self.weights, self.limit = Restorer(costs), weights, limit
        self.known: dict[str, float] = {}
        self.heads = {f.removeprefix("=")[:SHORTEST_HEAD] for f in weights}
        self.tree = head_tree(self.heads)

    def weight(self, words: list[str]) -> float:
        get = self.weights.get
        return max((get(f, 0.0) for w in words if w[:SHORTEST_HEAD] in self.heads for f in features(w)), default=0.0)

    def chunk_weight(self, chunk: str) -> float:
        """The largest weight of a chunk's words; plain words that begin like no weighted one have none."""
        if chunk[-1] in PLAIN_EDGES and chunk[:-1].isalpha():
            chunk = chunk[:-1]  # one sign after a word changes no reading
        if chunk.isalpha() and chunk[:SHORTEST_HEAD] not in self.heads and not (DOUBLED.search(chunk) and may_begin(chunk, self.tree)):
            return 0.0
        return self.weight(self.restorer.words(chunk, self.tree))

    def measures(self, text: str) -> tuple[float, float, float]:
        """Largest weight, log of the weights' sum, log of the number of chunks."""
        text = text.lower()
        chunks = text.split()
        known, found = self.known, []
        for chunk in set(chunks):
            w = known.get(chunk)
            if w is None:
                if len(known) >= self.limit:
                    known.clear()
                w = known[chunk] = self.chunk_weight(chunk)
            if w:
                found.append(w)
        found += [w for s in self.restorer.spaced(text) if (w := self.weight([s]))]
        return max(found, default=0.0), math.log1p(sum(found)), math.log1p(len(chunks))


_scorers: dict[str, Scorer] = {}


class Model:
    """What ``fit`` learned; each worker keeps one scorer, that of the model it used last."""

    def __init__(self, costs: list, weights: dict[str, float], regression: logistic.Logistic | None = None):
        self.costs, self.weights, self.regression = costs, weights, regression
        self.name = uuid.uuid4().hex

    @property
    def scorer(self) -> Scorer:
        if self.name not in _scorers:
            _scorers.clear()
            _scorers[self.name] = Scorer(self.costs, self.weights)
        return _scorers[self.name]

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.scorer.measures(t) for t in texts], float).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(self.regression.logit(x), -30, 30)))


def _word_counts(rows: DataFrame, costs: list) -> DataFrame:
    """(feature, toxic, clean): texts of the sample that hold it. Tasks count first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts, known = Restorer(costs), (Counter(), Counter()), {}
        for batch in batches:
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = text.lower()
                chunks = set(text.split())
                if len(known) > 200_000:
                    known.clear()
                known.update((c, restorer.words(c)) for c in chunks if c not in known)
                words = {w for c in chunks for w in known[c]} | set(restorer.spaced(text))
                counts[label > 0].update({f for w in words for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield _counted(counts)
                counts = (Counter(), Counter())
        yield _counted(counts)

    counted = rows.mapInArrow(count, "feature string, toxic long, clean long")
    return counted.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _counted(counts: tuple[Counter, Counter]) -> pa.RecordBatch:
    names = list(counts[0] | counts[1])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], ["feature", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Character model of all ``docs``, word weights and regression of at most ``bound`` labelled rows.

    A feature gets a weight if its toxic share is above the average by more than chance explains
    among that many features (log-likelihood ratio above the log of their number)."""
    costs = trigram_costs(character_counts(docs))
    rows = staged(fit_sample(docs, labels, "toxic", bound), "fit-sample")
    total = {r["fit_label"]: r["count"] for r in rows.groupBy("fit_label").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    weights: dict[str, float] = {}
    if toxic and clean:
        counted = staged(_word_counts(rows, costs), "word-counts")
        kinds = max(1, counted.count())
        rate, n = toxic / (toxic + clean), F.col("toxic") + F.col("clean")
        evidence = F.col("toxic") * F.log(F.col("toxic") / n / rate) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - rate))).otherwise(0.0)
        kept = counted.where((F.col("toxic") > 0) & (F.col("toxic") / n > rate) & (evidence > math.log(kinds)))
        for r in kept.collect():  # bounded by the sample
            weights[r["feature"]] = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))
        weights = {f: w for f, w in weights.items() if w > 1}
    model = Model(costs, weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.scorer.measures(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*x, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns] + [batch.column(2)], ["a", "b", "c", "y"])

    sample = np.array(rows.mapInArrow(measure, "a double, b double, c double, y int").collect(), float).reshape(-1, 4)
    sample = sample[np.lexsort(sample.T)]  # the same model whatever the partitions
    return Model(costs, weights, logistic.fit(sample[:, :3], sample[:, 3]))


def score(text: Column, model: Model) -> Column:
    """Probability that a text (null: empty) is toxic."""

    @pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score([t or "" for t in batch]), dtype=float)

    return scored(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ``threshold`` on) of every row of ``docs``.

    Null texts count as empty; null and repeated ids are kept (a null id is not held out); without
    labels of both kinds every score is the smoothed share of toxic labels; an empty table gives no
    rows; other columns are ignored."""
    model = fit(docs, labels, bound)
    rows = ready(docs).select("doc_id", score(F.col("text").cast("string"), model).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` scored below ``threshold``, all their columns as they are."""
    return docs.where(score(F.col("text").cast("string"), model) < threshold)
