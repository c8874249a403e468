"""Secrets in texts: fixed patterns, and values in credential contexts that are costly to guess.

Patterns find assignments, access keys and long hexadecimal strings. Other values that follow a
credential word ("pwd: ...", "Authorization: Bearer ...", "user:...@host") are judged by how many
guesses they would take: dynamic programming over the value finds the cheapest way to compose it of
common words, dates, repeats, keyboard walks and brute-force spans, as an attacker would. A value
that takes at least ``min_guess_bits`` bits is a secret; placeholders and plain words stay below.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm.common import ready

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 or more among those of [0-9a-f]+

#: A credential word before a value: with a sign or "is" between them, or as the name of an element.
_NAMES = r"(?:password|passwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|pwd)s?"
_SIGN = r"[:=]++(?:(?<==)>)?"
CONTEXT = re.compile(
    rf"""(?:{_NAMES}["']?[\x20\t]*+(?:{_SIGN}|\bis\b(?:[\x20\t]*+[:=]++)?+)[\x20\t]*+|(?<![a-z])pass["']?[\x20\t]*+{_SIGN}[\x20\t]*+|(?<=[.:_<-])(?:{_NAMES}|pass)>(?=[^<>\n]++</)[\x20\t]*+|\bbearer[\x20\t]++)(?=\S)""",
    re.I | re.A,
)
URL_CONTEXT = re.compile(r"://([^\s:/@]*+):(?=\S)")
QUOTED = re.compile(r""""((?:[^"\\\n]++|\\.)++)"|'((?:[^'\\\n]++|\\.)++)'""")
#: Where an unquoted value ends: white space, the name of the next field, an HTML end tag.
VALUE_END = re.compile(r"""\s|[,;][{\[(]*(?:[A-Za-z_]{3,}=|"[\w-]+":|'[\w-]+':)|</[A-Za-z]\w*>|\Z""")
SPACE = re.compile(r"\s|\Z")
#: A port and what follows it; there only a password without quotes and brackets is looked for.
PORT = re.compile(r"\d{2,5}[/?#\"'<>\\]")
AFTER_PORT = re.compile(r"""[\s"'@,;<>(){}\[\]]|\Z""")
HOST = re.compile(r"""@(?:[a-z0-9_.-]+|\[[0-9a-f:.]+\])(?::\d+)?(?![^\s/?"'<>(),;\]}])""")
#: What may follow a value without belonging to it, apart from closing brackets.
TRAILING = ".,:;!?\"'"
BRACKETS = {")": "(", "]": "[", "}": "{", ">": "<"}
#: Placeholders such as <password>, {password} and ${PASSWORD}.
WRAPPED = re.compile(r"[$#%]?(?:\((.+)\)|\[(.+)\]|\{(.+)\}|<(.+)>)", re.S)
WRAP_BITS = 3.0  # for the choice of the brackets around a value
#: Lower-case parts of the patterns' credential words; a text with none of them has no context.
HINTS = ("pass", "secret", "token", "key", "credential", "pwd", "bearer")


# Words that attackers try first, most common first.
COMMON_WORDS = (
    "password admin welcome login letmein master dragon monkey shadow sunshine princess football baseball superman "
    "iloveyou trustno michael jordan hunter ranger batman soccer hockey killer george charlie andrew thomas robert "
    "daniel summer winter spring autumn love secret test user guest root default changeme example sample dummy "
    "placeholder redacted none null true false token key value string your here insert enter the and for with this "
    "that from have not are you was will can all has been they one two three new time data server mysql postgres "
    "oracle public private access account service system network internet computer security company office home "
    "work school family friend happy orange banana cheese cookie coffee flower angel heart star moon sun blue green "
    "black white red silver golden tiger lion eagle wolf horse pass word api prod dev staging client manager"
).split()
# Keyboard rows; neighbours on a row, either way, are a walk.
KEYBOARD_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
# Letters that digits and signs commonly replace.
PLAIN_LETTER = str.maketrans("013457@$!", "oieastasi")

DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
DATE_BITS = {4: 7.0, 6: 10.5, 7: 10.5, 8: 15.2, 9: 15.2, 10: 16.5}
NEAR = 16  # longer than any word or date
SEGMENT_BITS = 1.0  # for the choice of kind and place of a segment


@cache
def _ranks() -> dict[str, int]:
    return {w: k for k, w in enumerate(COMMON_WORDS, 1)}


@cache
def _steps() -> dict[str, str]:
    """Right neighbours of each key, over all rows."""
    out: dict[str, str] = {}
    for row in KEYBOARD_ROWS:
        for a, b in zip(row, row[1:]):
            out[a] = out.get(a, "") + b
    return out


def _char_bits(c: str) -> float:
    """Bits of one character of a brute-force span: its alphabet's size."""
    size = 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100
    return math.log2(size)


def _runs(n: int, joined) -> tuple[list[int], list[int]]:
    """Beginning and end of the run that each place lies in; ``joined(k)``: k and k + 1 share one."""
    first, last = list(range(n)), list(range(n))
    for k in range(n - 1):
        if joined(k):
            first[k + 1] = first[k]
    for k in range(n - 2, -1, -1):
        if joined(k):
            last[k] = last[k + 1]
    return first, last


def guess_bits(value: str) -> float:
    """log2 of the guesses that the cheapest segmentation of ``value`` takes; linear in its length.

    Any segment may begin and end anywhere in a run of repeats or neighbouring keys up to twice
    ``NEAR`` long. In a longer one it begins within ``NEAR`` characters of the run's beginning and ends
    within as many of its end: another cut inside the run would cost a segment to save one bit."""
    n = len(value)
    lower = value.lower() if len(value.lower()) == n else value
    plain = lower.translate(PLAIN_LETTER)
    ranks, steps, heads = _ranks(), _steps(), _heads()
    longest = max(map(len, ranks))
    repeats = [(period, *_runs(max(0, n - period), lambda k, p=period: value[k] == value[k + p] and value[k + 1] == value[k + 1 + p])) for period in (1, 2, 3)]
    walks = [_runs(n, lambda k, w=way: _next(lower[k], lower[k + 1], w, steps)) for way in (1, -1)]
    best = [0.0] + [math.inf] * n  # cheapest cost of the first k characters
    brute = [math.inf] * (n + 1)  # the same if a brute-force span ends there
    for i in range(n):
        cost = best[i] + SEGMENT_BITS
        step = _char_bits(value[i])
        brute[i + 1] = min(brute[i] + step, cost + step)
        best[i + 1] = min(best[i + 1], brute[i + 1])
        if lower[i : i + 3] in heads or plain[i : i + 3] in heads:
            for size in range(3, min(longest, n - i) + 1):
                rank = ranks.get(lower[i : i + size])
                swapped = 0.0
                if rank is None:
                    rank, swapped = ranks.get(plain[i : i + size]), 2.0
                if rank:
                    upper = sum(c.isupper() for c in value[i : i + size])
                    bits = math.log2(rank + 1) + swapped + (0 if not upper else 1 if upper == size or value[i].isupper() and upper == 1 else upper)
                    best[i + size] = min(best[i + size], cost + bits)
        if value[i].isdigit():
            for size, bits in DATE_BITS.items():
                if i + size <= n and best[i + size] > cost + bits and DATE.fullmatch(value, i, i + size):
                    best[i + size] = cost + bits
        for period, first, last in repeats:  # "aaaa", "abab", "abcabc": the unit and how often
            if i < n - period and value[i] == value[i + period] and i - first[i] < NEAR:
                unit = cost + sum(map(_char_bits, value[i : i + period]))
                for j in _ends(i + max(3, 2 * period), last[i] + period + 1):
                    best[j] = min(best[j], unit + math.log2((j - i) / period))
        for first, last in walks:  # keyboard walks and alphabetic runs, forwards or backwards
            if last[i] - i >= 2 and i - first[i] < NEAR:
                for j in _ends(i + 3, last[i] + 1):
                    best[j] = min(best[j], cost + 6.0 + math.log2(j - i))
    return best[n]


def _ends(shortest: int, end: int) -> range:
    return range(shortest if end - shortest <= 2 * NEAR else end - NEAR, end + 1)


@cache
def _heads() -> frozenset[str]:
    return frozenset(w[:3] for w in COMMON_WORDS)


def _next(a: str, b: str, way: int, steps: dict[str, str]) -> bool:
    return b in steps.get(a, "") if way > 0 else a in steps.get(b, "")


def _hinted(text: str) -> bool:
    lower = text.lower()
    return any(h in lower for h in HINTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if _hinted(text) else []
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _trimmed(text: str, start: int, end: int) -> int:
    """End of a value without the punctuation and the unbalanced closing brackets after it."""
    surplus = {c: text.count(c, start, end) - text.count(o, start, end) for c, o in BRACKETS.items()}
    while end > start and ((c := text[end - 1]) in TRAILING or surplus.get(c, 0) > 0):
        if c in surplus:
            surplus[c] -= 1
        end -= 1
    return end


def context_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values after credential words."""
    at = 0
    while m := CONTEXT.search(text, at):
        at = m.end()
        if quoted := QUOTED.match(text, at):
            start, at = quoted.span(quoted.lastindex)
            yield start, at
        else:
            start = at + (text[at] in "\"'")  # a quote that is not closed on its line
            at = VALUE_END.search(text, start).start()
            if at > start:
                yield start, _trimmed(text, start, at)


def url_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the passwords in URLs: up to the first @ with a host after it, else the last."""
    at = stop = run = 0  # ends of the run without white space and of that without quotes and brackets
    sign = -1  # the next @
    while m := URL_CONTEXT.search(text, at):
        start = at = m.end()
        if start >= stop:
            stop = SPACE.search(text, start).start()
        if sign < start:
            sign = found if (found := text.find("@", start)) >= 0 else len(text)
        if sign >= stop:
            at = stop
            continue
        if m[1] and PORT.match(text, start):
            if start >= run:
                run = AFTER_PORT.search(text, start).start()
            end = run if run < len(text) and text[run] == "@" else -1
        else:
            end = host.start() if (host := HOST.search(text, start, stop)) else text.rfind("@", start, stop)
        if end > start:
            at = end
            quoted = QUOTED.fullmatch(text, start, end)
            yield quoted.span(quoted.lastindex) if quoted else (start, end)


def value_bits(value: str) -> float:
    """``guess_bits``, brackets around the whole value taken as one choice."""
    bits = guess_bits(value)
    m = WRAPPED.fullmatch(value)
    return min(bits, WRAP_BITS + guess_bits(m[m.lastindex])) if m else bits


def find_spans(text: str, min_guess_bits: float, min_length: int = 6) -> tuple[list, list]:
    """(base spans, base spans and those of costly values), by start, then kind."""
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))  # the furthest end so far
    added = []
    for start, end in chain(context_values(text) if _hinted(text) else (), url_values(text)):
        before = bisect_right(starts, start)
        inside = before and end <= reach[before - 1]
        if end - start >= min_length and not inside and value_bits(text[start:end]) >= min_guess_bits:
            added.append((start, 3, end))
    return base, sorted({*base, *added})


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked_text(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """``text`` with every run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


#: Passwords of 8 random letters take 38 bits; words with a year stay below 30.
MIN_GUESS_BITS = 36.0


def secrets(text: Column, min_guess_bits: float = MIN_GUESS_BITS) -> Column:
    """Struct of n_assign, n_access, n_hex, n_guess, base_sha256 and spans of a text (null: empty)."""

    @pandas_udf("n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                base, spans = find_spans(text or "", min_guess_bits)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return scan(text)


def secret_spans(docs: DataFrame, min_guess_bits: float = MIN_GUESS_BITS) -> DataFrame:
    """doc_id and the fields of ``secrets`` for every row of ``docs``. Null texts count as empty;
    null and repeated ids are kept; an empty table gives no rows; other columns are ignored."""
    rows = ready(docs).select("doc_id", secrets(F.col("text").cast("string"), min_guess_bits).alias("found"))
    return rows.select("doc_id", "found.*")


def without_secrets(docs: DataFrame, mask: str = "[secret]", min_guess_bits: float = MIN_GUESS_BITS) -> DataFrame:
    """All rows of ``docs`` with every secret in ``text`` replaced by ``mask``; a null text stays
    null. ``n_chars``, where there is one, follows the new text."""

    @pandas_udf("string")
    def redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked_text(t, find_spans(t, min_guess_bits)[1], mask) for t in texts], dtype=object)

    out = ready(docs).withColumn("text", redact(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select([f"`{c}`" for c in docs.columns])
