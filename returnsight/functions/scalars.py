"""Column-expression helpers; all stay inside whole-stage codegen (no Python UDF)."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decode_flag(c: str | Column) -> Column:
    """'Y' -> 1, 'N' -> 0, anything else (including NULL) -> NULL, like a CASE without ELSE."""
    c = _col(c)
    return F.when(c == "Y", F.lit(1)).when(c == "N", F.lit(0))


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL so that averages, deviations and correlations skip it as pandas does."""
    c = _col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_ln(c: str | Column) -> Column:
    """Natural log, NULL for x <= 0 (numpy gives -inf / NaN; both are 'missing' downstream)."""
    c = _col(c)
    return F.when(c > 0, F.ln(c))


def icontains(c: str | Column, pattern: str) -> Column:
    """Case-insensitive regex search with Python's Unicode case folding; NULL text is no match."""
    return F.coalesce(_col(c).rlike(f"(?iu){pattern}"), F.lit(False))


def key_hash(key: str | Column, salt: int | str) -> Column:
    """Deterministic order of keys: md5 of 'key|salt' in hex, the same in any engine that has md5
    and independent of partitioning and task retries (unlike ``rand`` / ``randomSplit``)."""
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f"|{salt}")))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; float sums differ in the last bits across summation orders."""
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def ship_by_value(module: str) -> None:
    """Send a module's task code with the tasks, so executors need not have the package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
