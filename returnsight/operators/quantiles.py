"""Exact quantiles by refinement: counts over ever narrower ranges, no sort and no shuffle of rows.

Doubles are read as 64-bit integers in the same order. Every pass counts, for each order statistic
still open, how many values of its range have which next ``BITS`` bits, with the smallest and the
largest value of each; the statistic's range is then narrowed to the bits that hold its rank. A
statistic is known once its range holds one value (however many rows have it), or its rank is the
first or the last of the range. All columns and probabilities share the passes, of which there are
at most 64 / ``BITS`` whatever the number of rows; a task holds ``2 ** BITS`` counts a statistic, and
so many of them at most reach the driver.

Rows are read once a pass, so the input should be a written table or cheap to compute.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.functions import nan_to_null, ship_by_value

ship_by_value(__name__)

BITS = 13
_LOWEST = np.iinfo(np.int64).min
_MAGNITUDE = np.iinfo(np.int64).max


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the doubles; both zeros are one value."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _MAGNITUDE, bits)


def value_of(key: int) -> float:
    return float(np.array([key ^ _MAGNITUDE if key < 0 else key], np.int64).view(np.float64)[0])


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return (keys ^ _LOWEST).view(np.uint64)


@dataclass(frozen=True)
class _Range:
    """Values of a column whose keys begin with the ``known`` bits of ``prefix``."""

    column: int
    prefix: int = 0
    known: int = 0

    @property
    def bits(self) -> int:
        return min(BITS, 64 - self.known)

    def digits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys inside the range and their next bits."""
        own = _unsigned(keys)
        if self.known:
            inside = (own >> np.uint64(64 - self.known)) == np.uint64(self.prefix)
            keys, own = keys[inside], own[inside]
        after = np.uint64(64 - self.known - self.bits)
        return keys, ((own >> after) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def narrowed(self, digit: int) -> _Range:
        return _Range(self.column, (self.prefix << self.bits) | digit, self.known + self.bits)


_COUNTED = "range int, digit int, n long, least long, most long"
_MISSING = -1  # the digit under which a column's missing values are counted


def _counter(ranges: list[_Range], columns: int, first: bool):
    def run(batches):
        size = 1 << BITS
        n = np.zeros((len(ranges), size), np.int64)
        least = np.full((len(ranges), size), _MAGNITUDE)
        most = np.full((len(ranges), size), _LOWEST)
        missing = np.zeros(columns, np.int64)
        for batch in batches:
            keys = []
            for c in range(columns):
                column = batch.column(c)
                missing[c] += column.null_count
                keys.append(ordered_keys(column.drop_null().to_numpy(zero_copy_only=False)))
            for r, own in enumerate(ranges):
                inside, digit = own.digits(keys[own.column])
                n[r] += np.bincount(digit, minlength=size)
                np.minimum.at(least[r], digit, inside)
                np.maximum.at(most[r], digit, inside)
        r, digit = np.nonzero(n)
        rows = [r, digit, n[r, digit], least[r, digit], most[r, digit]]
        if first:  # ranges are the columns
            rows = [np.concatenate([a, b]) for a, b in zip(rows, [np.arange(columns), np.full(columns, _MISSING), missing, missing, missing], strict=True)]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(rows, kinds, strict=True)], [f.split()[0] for f in _COUNTED.split(", ")])

    return run


def _counts(values: DataFrame, ranges: list[_Range], columns: int, first: bool = False) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per range (digit, n, least, most), by digit."""
    counted = values.mapInArrow(_counter(ranges, columns, first), _COUNTED).groupBy("range", "digit")
    out: dict[int, list[tuple[int, int, int, int]]] = {r: [] for r in range(len(ranges))}
    for row in counted.agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect():
        out[row["range"]].append((row["digit"], row["n"], row["least"], row["most"]))
    return {r: sorted(rows) for r, rows in out.items()}


def order_statistics(values: DataFrame, wanted: dict[int, set[int]], counted: dict[int, list[tuple[int, int, int, int]]]) -> dict[tuple[int, int], float]:
    """The values at the ranks ``wanted`` (column -> ranks) from the counts of the first pass."""
    found: dict[tuple[int, int], float] = {}
    columns = len(values.columns)
    open_ranks = [(c, rank, _Range(c), rank) for c, ranks in wanted.items() for rank in ranks]
    rows = {_Range(c): counted[c] for c in wanted}
    while True:
        still = []
        for c, rank, own, within in open_ranks:
            for digit, n, least, most in rows[own]:
                if digit == _MISSING:
                    continue
                if within < n:
                    break
                within -= n
            if least == most or within in (0, n - 1):
                found[c, rank] = value_of(least if within == 0 else most)
            else:
                still.append((c, rank, own.narrowed(digit), within))
        if not still:
            return found
        open_ranks, ranges = still, sorted({own for _, _, own, _ in still}, key=lambda r: (r.column, r.prefix))
        rows = dict(zip(ranges, _counts(values, ranges, columns).values(), strict=True))


def _places(count: int, p: float) -> tuple[int, int, float]:
    h = (count - 1) * p
    return math.floor(h), math.ceil(h), h - math.floor(h)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    *,
    interpolation: str = "linear",
    nan_policy: str = "omit",
) -> dict[str, list[float | None]]:
    """Exact quantiles of several columns in the same few passes.

    ``interpolation`` is ``'linear'`` (pandas / numpy default) or ``'midpoint'``. Missing values are
    skipped with ``nan_policy='omit'``; with ``'propagate'`` a column holding any missing value yields
    None, like numpy on an array containing NaN. A column without values yields None."""
    cols = list(cols)
    values = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    counted = _counts(values, [_Range(i) for i in range(len(cols))], len(cols), first=True)
    present = {i: sum(n for digit, n, _, _ in rows if digit != _MISSING) for i, rows in counted.items()}
    missing = {i: sum(n for digit, n, _, _ in rows if digit == _MISSING) for i, rows in counted.items()}
    usable = [i for i in range(len(cols)) if present[i] and not (nan_policy == "propagate" and missing[i])]
    found = order_statistics(values, {i: {at for p in probs for at in _places(present[i], p)[:2]} for i in usable}, counted)
    out: dict[str, list[float | None]] = {c: [None for _ in probs] for c in cols}
    for i in usable:
        for j, p in enumerate(probs):
            lo, hi, share = _places(present[i], p)
            a, b = found[i, lo], found[i, hi]
            if a == b:
                out[cols[i]][j] = a
            else:
                out[cols[i]][j] = (a + b) / 2.0 if interpolation == "midpoint" else a + (b - a) * share
    return out


def exact_median(df: DataFrame, col: str) -> float | None:
    return exact_quantiles(df, [col], [0.5])[col][0]
