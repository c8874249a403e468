"""License notices in texts: winnowed template fingerprints pick candidates, alignment judges them.

Templates are split into words; of every ``WINDOW`` neighbouring runs of ``GRAM`` words the one with
the smallest hash is kept, and an inverted index maps it to its templates and positions. Any passage
sharing WINDOW + GRAM - 1 words in a row with a template thus shares a kept run. A text's runs found
in the index propose a template and the place where it would begin; proposals a few words apart are
one candidate. A banded alignment of template and text then gives the words that match in order, the
coverage of the template and the exact span. Of overlapping matches the one with most words stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm.common import ready

GRAM, WINDOW = 3, 2
#: Insertions or omissions that one alignment can be off the straight line by.
BAND = 8
MIN_COVERAGE = 0.8

# Wordings of public license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)
_GNU = (("GPL", "General", "1.0 2.0 3.0"), ("LGPL", "Lesser General", "2.1 3.0"), ("LGPL", "Library General", "2.0"), ("AGPL", "Affero General", "3.0"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-ND", "Attribution-NoDerivs"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivs"))
# The same notices of the sibling licenses.
_SIBLINGS = (
    *((n, f"{verb} under the {title}.") for verb in ("Released", "Licensed") for n, title in (("Apache-2.0", "Apache License, Version 2.0"), ("MIT", "MIT License"), ("BSD", "BSD License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("MPL-1.1", "Mozilla Public License, version 1.1"), ("MPL-2.0", "Mozilla Public License, version 2.0"))),
    *((f"{n}-{v}", f"{start} under the GNU {title} Public License, version {v.removesuffix('.0')}.") for start in ("This work is licensed", "Released") for n, title, versions in _GNU for v in versions.split()),
    *((f"{n}-{v}", f"you can redistribute it and/or modify it under the terms of the GNU {title} Public License as published by the Free Software Foundation; either version {v.removesuffix('.0')} of the License") for n, title, versions in _GNU for v in versions.split()),
    *((f"CC-{n}-{v}", f"Licensed under CC {n} {v}.") for n in dict(_CC) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")),
    *((f"CC-{n}-{v}", f"This work is licensed under a Creative Commons {title} {v} {kind} License") for n, title in _CC for v, kind in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))),
)
_known = {text for _, text in TEMPLATES}
TEMPLATES += tuple(t for t in _SIBLINGS if t[1] not in _known)

# Words that tell licenses apart. Those of a template must be found, as must its version.
NAMES = frozenset("apache mit bsd isc mozilla gnu cc commons unencumbered clause".split())
# Words that turn one license into another, so that none may be inserted either.
CHANGES = frozenset("lesser affero nc nd sa noncommercial commercial noderivatives noderivs derivatives derivs sharealike alike".split())

WORD = re.compile("[a-z0-9]+")


class Match(NamedTuple):
    license: str
    coverage: float
    start: int
    end: int
    words: int


def words_of(text: str) -> list[tuple[str, int, int]]:
    # letter by letter, so that positions stay those of the text
    lower = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(lower)]


def winnowed(words: list[str]) -> set[int]:
    """Positions of the kept runs of GRAM words."""
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + GRAM])) for k in range(len(words) - GRAM + 1)]
    return {min(range(k, min(k + WINDOW, len(hashes))), key=lambda i: (hashes[i], -i)) for k in range(max(1, len(hashes) - WINDOW + 1))} if hashes else set()


@cache
def template_index(templates: tuple = TEMPLATES) -> tuple[list[list[str]], dict[tuple, list[tuple[int, int]]], frozenset[str]]:
    """(words of each template, kept run -> (template, position), a long word of each kept run)."""
    split = [[w for w, _, _ in words_of(text)] for _, text in templates]
    runs: dict[tuple, list[tuple[int, int]]] = {}
    for t, words in enumerate(split):
        for k in winnowed(words):
            runs.setdefault(tuple(words[k : k + GRAM]), []).append((t, k))
    return split, runs, frozenset(max(r, key=lambda w: (len(w), w)) for r in runs)


def aligned(template: list[str], words: list[str], start: int, band: int = BAND) -> list[tuple[int, int]]:
    """(place in the template, position in ``words``) of the words matched, in order, by the alignment
    of ``template`` around ``start`` with most matches less skipped template words; it leaves the line
    by ``band`` words at most."""
    width = 2 * band + 1
    score, step = [0] * width, []
    for i, word in enumerate(template):
        row, moves = [0] * width, bytearray(width)
        for d in range(width):  # text position of cell (i, d): start + i + d - band
            j = start + i + d - band
            if 0 <= j < len(words) and words[j] == word:
                best, move = score[d] + 2, 1
            else:
                best, move = score[d] - 1, 0
            if d + 1 < width and score[d + 1] - 1 > best:  # the template's word is missing
                best, move = score[d + 1] - 1, 2
            if d and row[d - 1] - 1 > best:  # the text has a word more
                best, move = row[d - 1] - 1, 3
            row[d], moves[d] = best, move
        score = row
        step.append(moves)
    d, i, found = max(range(width), key=lambda k: (score[k], -abs(k - band))), len(template) - 1, []
    while i >= 0:
        move = step[i][d]
        if move == 1:
            found.append((i, start + i + d - band))
        if move == 3:
            d -= 1
            continue
        d += move == 2
        i -= 1
    return found[::-1]


def _nonzero(word: str) -> bool:
    """Whether a word is a number other than zero, of whatever length."""
    return word.isdigit() and bool(word.strip("0"))


def chained(parts: list[list[tuple[int, int]]], gap: int) -> list[int]:
    """The most positions that can be taken from the alignments ``parts`` with places and positions
    rising, neighbours at most ``gap`` words apart in the text."""
    pairs = sorted({pair for part in parts for pair in part}, key=lambda pair: (pair[1], -pair[0]))
    best: list[tuple[int, int]] = []  # (length, index of the pair before) of the longest chain to each pair
    ends: dict[int, int] = {}  # place -> the pair that ends the longest chain there, not out of reach
    for n, (i, j) in enumerate(pairs):
        length, before = 0, -1
        for place, k in list(ends.items()):
            if j - pairs[k][1] > gap + 1:
                del ends[place]
            elif place < i and best[k][0] > length and pairs[k][1] < j:
                length, before = best[k][0], k
        best.append((length + 1, before))
        if i not in ends or best[ends[i]][0] <= length + 1:
            ends[i] = n
    at, out = max(range(len(best)), key=lambda n: best[n][0]), []
    while at >= 0:
        out.append(pairs[at][1])
        at = best[at][1]
    return out[::-1]


def _needed(template: list[str]) -> frozenset[str]:
    """Words of a template that must be found; a zero after a number may be left out."""
    return frozenset(w for k, w in enumerate(template) if w in NAMES or w in CHANGES or (w.isdigit() and not (w == "0" and k and template[k - 1].isdigit())))


@cache
def _needed_of(templates: tuple) -> list[frozenset[str]]:
    return [_needed(words) for words in template_index(templates)[0]]


def told_apart(template: list[str], text: str, tokens: list[tuple[str, int, int]], hits: list[int]) -> bool:
    """Whether the words that tell licenses apart are those of the template: all are matched, and none
    is inserted, nor a number beside the version."""
    words, matched = [w for w, _, _ in tokens[hits[0] : hits[-1] + 2]], {h - hits[0] for h in hits}
    if not _needed(template) <= {words[k] for k in matched}:
        return False
    last = hits[-1] - hits[0]
    for k in range(last + 1):
        if k in matched:
            continue
        if words[k] in CHANGES:
            return False
        beside = [words[k - 1] if k - 1 in matched else "", words[k + 1] if k + 1 in matched else ""]
        if _nonzero(words[k]) and (beside[0] in ("version", "v") or any(w.isdigit() for w in beside)):
            return False
    # the version may go on after the last word
    after = words[last + 1] if len(words) > last + 1 else ""
    goes_on = _nonzero(after) and words[last].isdigit() and text[tokens[hits[-1]][2] : tokens[hits[-1] + 1][1]] == "."
    return not goes_on


def find_licenses(text: str, templates: tuple = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> list[Match]:
    """Matches in a text by position; spans count code points, the end excluded."""
    split, runs, hints = template_index(templates)
    lower = text.lower()
    if not any(h in lower for h in hints):
        return []
    tokens = words_of(text)
    words = [w for w, _, _ in tokens]
    proposed: dict[int, list[int]] = {}
    for k in range(len(words) - GRAM + 1):
        for t, at in runs.get(tuple(words[k : k + GRAM]), ()):
            proposed.setdefault(t, []).append(k - at)
    found, seen = [], set(words)
    for t, starts in proposed.items():
        if not _needed_of(templates)[t] <= seen:
            continue
        size, groups, last = len(split[t]), [], None
        gap = max(BAND, size)
        for start in sorted(set(starts)):
            if last is not None and start - last <= BAND // 2:
                continue
            part = aligned(split[t], words, start)
            if not part:
                continue
            if last is None or start - last > gap:
                groups.append([])
            groups[-1].append(part)
            last = start
        for parts in groups:
            whole = [hits for part in parts if len(hits := [j for _, j in part]) >= min_coverage * size]
            if not whole and len(parts) > 1 and len({i for part in parts for i, _ in part}) >= min_coverage * size:
                whole = [hits for hits in [chained(parts, gap)] if len(hits) >= min_coverage * size]
            for hits in whole:
                if told_apart(split[t], text, tokens, hits):
                    found.append(Match(templates[t][0], len(hits) / size, tokens[hits[0]][1], tokens[hits[-1]][2], len(hits)))
    kept: list[Match] = []
    for m in sorted(set(found), key=lambda m: (-m.words, -m.coverage, m.start, m.license)):
        if all(m.end <= o.start or o.end <= m.start for o in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m.start)


def licenses(text: Column, min_coverage: float = MIN_COVERAGE) -> Column:
    """Array of (license, coverage, start, end) of a text (null: empty)."""

    @pandas_udf("array<struct<license string, coverage double, start long, end long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[m._asdict() for m in find_licenses(t or "", min_coverage=min_coverage)] for t in texts], dtype=object)

    return scan(text)


def license_scan(docs: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_licenses and licenses (array by position) of every row of ``docs``. Null texts count
    as empty; null and repeated ids are kept; an empty table gives no rows; other columns are ignored."""
    rows = ready(docs).select("doc_id", licenses(F.col("text").cast("string"), min_coverage).alias("licenses"))
    return rows.select("doc_id", F.size("licenses").alias("n_licenses"), "licenses")
