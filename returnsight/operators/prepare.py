"""Preparation of the feature table for modelling.

Order (the reference's effective order): label at the median, label-encode size and color,
family / brand flags, natural logs, IQR outlier removal, mean imputation, z-scores. Scalars
(median, quartiles, means, deviations) are computed by distributed aggregations and reach the
driver as a few numbers that the next step uses as literals, so no step broadcasts or collects
a data-sized object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.config import ZSCORE_COLUMNS, Params
from returnsight.functions import icontains, nan_to_null, safe_ln
from returnsight.operators.features import broadcast_if_small, force_skew_split
from returnsight.operators.quantiles import exact_median, exact_quantiles
from returnsight.operators.ranking import dense_codes_long
from returnsight.session import materialise

ENCODED_COLUMNS = ("sku_size", "sku_color")


def return_label(features: DataFrame, label_col: str = "label") -> DataFrame:
    """1 when ``return_rate`` is strictly above the exact median, else 0 (missing rate -> 0)."""
    med = exact_median(features, "return_rate")
    above = F.col("return_rate") > F.lit(med).cast("double")
    return features.withColumn(label_col, F.coalesce(above, F.lit(False)).cast("int"))


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label_col)


def encoding_dictionary(df: DataFrame, cols: Sequence[str] = ENCODED_COLUMNS) -> DataFrame:
    """Long dictionary ``(column_name, category, code)`` for every encoded column."""
    return dense_codes_long(df, cols)


def label_encode(df: DataFrame, cols: Sequence[str] = ENCODED_COLUMNS) -> DataFrame:
    """Replace each categorical column with its code. The dictionary has one row per category.

    Its rows and bytes are measured first: up to the broadcast bounds it is broadcast, so the frame
    is never shuffled by category (a category held by a third of the rows would otherwise land in one
    reduce task, once per encoded column). A larger dictionary is joined by sort-merge, whose skewed
    partitions AQE splits."""
    codes = materialise(encoding_dictionary(df, cols))
    force_skew_split(df)
    out = df
    for c in cols:
        d = codes.filter(F.col("column_name") == c).select(F.col("category").alias("_cat"), F.col("code").alias("_code"))
        d = broadcast_if_small(d)
        out = out.join(d, out[c].eqNullSafe(d["_cat"]), "left").withColumn(c, F.col("_code")).drop("_cat", "_code")
    return out


def text_flags(df: DataFrame, params: Params) -> DataFrame:
    """Family and brand flags from ``product_desc`` as 0/1 integers."""
    return df.withColumn("footwear", icontains("product_desc", params.family_pattern).cast("int")).withColumn(
        "brand", icontains("product_desc", params.brand_pattern).cast("int")
    )


def log_columns(df: DataFrame, cols: Sequence[str], *, in_place: bool = True) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(c if in_place else f"ln_{c}", safe_ln(c))
    return out


def midpoint_bounds(
    df: DataFrame, cols: Sequence[str], k: float, nan_policy: str = "propagate"
) -> dict[str, tuple[float | None, float | None, float | None, float | None]]:
    """(Q1, Q3, lower, upper) per column with numpy's 'midpoint' quartiles; bounds are Q1 - k*IQR, Q3 + k*IQR."""
    qs = exact_quantiles(df, cols, [0.25, 0.75], interpolation="midpoint", nan_policy=nan_policy)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None or q3 is None:
            out[c] = (q1, q3, None, None)
        else:
            iqr = q3 - q1
            out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_filter(
    df: DataFrame,
    cols: Sequence[str],
    k: float = 0.5,
    *,
    nan_policy: str = "propagate",
    overlap: str = "upper_only",
) -> DataFrame:
    """Drop rows with ``x >= upper`` or ``x <= lower`` (both inclusive), bounds from the input frame.

    Missing bounds (a missing value under ``nan_policy='propagate'``) drop nothing. When the two
    sets overlap (IQR = 0), ``overlap='upper_only'`` drops the upper set only, as the reference's
    second, failing drop does; ``overlap='both'`` drops both.
    """
    bounds = midpoint_bounds(df, cols, k, nan_policy)
    out = df
    for c in cols:
        _, _, lo, hi = bounds[c]
        if lo is None or hi is None:
            continue
        x = nan_to_null(F.col(c))
        upper = F.coalesce(x >= F.lit(hi), F.lit(False))
        lower = F.coalesce(x <= F.lit(lo), F.lit(False))
        if overlap == "upper_only" and hi <= lo and df.filter(upper & lower).limit(1).count() > 0:
            out = out.filter(~upper)
        else:
            out = out.filter(~(upper | lower))
    return out


def impute_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULL / NaN with the column mean (mean over non-missing values)."""
    means = df.agg(*[F.avg(nan_to_null(c)).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        if means[c] is not None:
            out = out.withColumn(c, F.coalesce(nan_to_null(c), F.lit(means[c])))
    return out


def zscores(df: DataFrame, cols: Sequence[str] = ZSCORE_COLUMNS, key: str = "sku_key") -> DataFrame:
    """|x - mean| / population std per column (scipy's default ddof=0); constant column -> NULL."""
    stats = df.agg(
        *[F.avg(nan_to_null(c)).alias(f"m_{c}") for c in cols],
        *[F.stddev_pop(nan_to_null(c)).alias(f"s_{c}") for c in cols],
    ).first()
    exprs = []
    for c in cols:
        m, s = stats[f"m_{c}"], stats[f"s_{c}"]
        z = F.abs(F.try_divide(nan_to_null(c) - F.lit(m).cast("double"), F.lit(s).cast("double")))
        exprs.append(F.when(F.lit(s).cast("double") > 0, z).alias(f"z_{c}"))
    return df.select(key, *exprs)
