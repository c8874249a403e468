"""Exploration: null counts, describe, correlation, box-plot statistics, schema inspection.

Each is one or two aggregation passes producing a long (column-per-row) frame; wide results
are unpivoted with ``unpivot`` so they stay DataFrames.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnsight.functions import nan_to_null
from returnsight.operators.quantiles import exact_quantiles


def _missing(c: str, dtype: T.DataType):
    col = F.col(c)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(column_name, null_count)``: NULL or NaN per column, one pass."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(_missing(c, types[c])).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_count")


def null_columns(df: DataFrame) -> list[str]:
    counts = null_counts(df).filter(F.col("null_count") > 0).collect()
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted((r["column_name"] for r in counts), key=order.get)


def columns_with_nulls(df: DataFrame, key: str = "sku_key") -> DataFrame:
    """The frame restricted to the columns that hold a missing value (plus the key)."""
    cols = [c for c in null_columns(df) if c != key]
    return df.select(key, *cols)


def numeric_columns(df: DataFrame) -> list[str]:
    numeric = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe().T``: count, mean, sample std, min, exact linear 25/50/75 %, max."""
    cols = list(cols or numeric_columns(df))
    norm = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    aggs = []
    for c in cols:
        aggs += [
            F.count(c).cast("long").alias(f"{c}__count"),
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"),
        ]
    row = norm.agg(*aggs).first()
    qs = exact_quantiles(norm, cols, [0.25, 0.5, 0.75], interpolation="linear")
    rows = []
    for c in cols:
        q = qs[c]
        rows.append((c, row[f"{c}__count"], row[f"{c}__mean"], row[f"{c}__std"], row[f"{c}__min"], q[0], q[1], q[2], row[f"{c}__max"]))
    schema = (
        "column_name string, count long, mean double, std double, min double, "
        "p25 double, p50 double, p75 double, max double"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation for every ordered pair over the rows where both are present; missing where
    one of the two does not vary (the diagonal included).

    Two aggregations: each column's count, mean and range, then sums of products of deviations from
    the means. A pair of columns without missing values needs one sum; a pair with some also needs its
    own counts, sums, squares and ranges."""
    cols = list(cols)
    norm = df.select(*[nan_to_null(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    x = [F.col(c) for c in norm.columns]
    one = norm.agg(F.count(F.lit(1)).alias("rows"), *[f(v).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("n", F.count), ("m", F.avg), ("lo", F.min), ("hi", F.max))]).first()
    whole = [one[f"n{i}"] == one["rows"] for i in range(len(cols))]
    d = [v - F.lit(one[f"m{i}"]).cast("double") for i, v in enumerate(x)]
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    sums = []
    for i, j in pairs:
        sums.append(F.sum(d[i] * d[j]).alias(f"p{i}_{j}"))
        if i != j and not (whole[i] and whole[j]):
            for own, by in ((i, j), (j, i)):
                v, dev = F.when(x[by].isNotNull(), x[own]), F.when(x[by].isNotNull(), d[own])
                sums += [F.count(v).alias(f"n{own}_{by}"), F.sum(dev).alias(f"s{own}_{by}"), F.sum(dev * dev).alias(f"q{own}_{by}"), F.min(v).alias(f"lo{own}_{by}"), F.max(v).alias(f"hi{own}_{by}")]
    two = norm.agg(*sums).first()

    def part(i: int, j: int) -> tuple[float, float, float, bool]:
        """Count, sum and sum of squares of i's deviations where j is present, and whether i varies."""
        if i == j or (whole[i] and whole[j]):
            return one[f"n{i}"], 0.0, two[f"p{i}_{i}"], one[f"lo{i}"] is not None and one[f"lo{i}"] < one[f"hi{i}"]
        lo = two[f"lo{i}_{j}"]
        return two[f"n{i}_{j}"], two[f"s{i}_{j}"], two[f"q{i}_{j}"], lo is not None and lo < two[f"hi{i}_{j}"]

    val: dict[tuple[int, int], float | None] = {}
    for i, j in pairs:
        (n, si, qi, vi), (_, sj, qj, vj) = part(i, j), part(j, i)
        r = None
        if vi and vj:
            spread = math.sqrt(max(0.0, qi - si * si / n)) * math.sqrt(max(0.0, qj - sj * sj / n))
            r = 1.0 if i == j else (two[f"p{i}_{j}"] - si * sj / n) / spread if spread else None
        val[i, j] = val[j, i] = r
    out = [(a, b, val[i, j]) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(out, "feature_a string, feature_b string, corr double")


def box_stats(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Numbers behind a box plot: linear quartiles, whiskers at the most extreme values inside
    ``Q1 - 1.5 IQR`` / ``Q3 + 1.5 IQR``, and the count of points outside them."""
    cols = list(cols)
    norm = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    qs = exact_quantiles(norm, cols, [0.25, 0.5, 0.75], interpolation="linear")
    aggs = []
    for c in cols:
        q1, _, q3 = qs[c]
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"{c}__lo"), F.lit(None).cast("double").alias(f"{c}__hi"), F.lit(0).cast("long").alias(f"{c}__out")]
            continue
        lo, hi = q1 - whisker * (q3 - q1), q3 + whisker * (q3 - q1)
        x = F.col(c)
        aggs += [
            F.min(F.when(x >= F.lit(lo), x)).alias(f"{c}__lo"),
            F.max(F.when(x <= F.lit(hi), x)).alias(f"{c}__hi"),
            F.count_if((x < F.lit(lo)) | (x > F.lit(hi))).cast("long").alias(f"{c}__out"),
        ]
    row = norm.agg(*aggs).first()
    rows = [
        (c, qs[c][0], qs[c][1], qs[c][2], row[f"{c}__lo"], row[f"{c}__hi"], row[f"{c}__out"]) for c in cols
    ]
    schema = "column_name string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, n_outliers long"
    return df.sparkSession.createDataFrame(rows, schema)


def schema_info(df: DataFrame) -> DataFrame:
    """``dtypes`` + non-null counts (pandas ``info(show_counts=True)``) in one pass."""
    nulls = {r["column_name"]: r["null_count"] for r in null_counts(df).collect()}
    total = df.count()
    rows = [(name, dtype, total - nulls[name]) for name, dtype in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column_name string, dtype string, non_null long")
