"""Feature builds for a moving date window from daily partial sums.

The lines of each day are reduced once to one row per (day, SKU) of sums and counts that add up, and
written partitioned by day. A feature table for any window of whole days adds up the days inside it:
the scan lists and reads their folders alone, and no line is read again. New or corrected days are
written over their own folders, so a repeated append changes nothing and other days are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.operators.features import PARTIAL_SUMS, daily_line_partials, features_from_partials
from returnsight.session import materialise
from returnsight.sources import read_table

#: (day, SKU) rows of a written file, about.
ROWS_PER_FILE = 2_000_000


def _days(params: Params) -> tuple[str, str]:
    for bound in (params.date_lo, params.date_hi):
        if len(bound.strip()) != len("2021-01-01"):
            raise ValueError(f"daily sums answer windows of whole days, not from or to {bound!r}")
    return params.date_lo, params.date_hi


def daily_partials(detail: DataFrame, params: Params) -> DataFrame:
    """Sums and counts per (day, SKU) of the lines inside the window. A SKU with a third of a day's
    lines leaves each map task as one row a day."""
    _days(params)
    return daily_line_partials(detail, params)


def append_days(spark: SparkSession, detail: DataFrame, path: str, params: Params) -> None:
    """Write the window's days, each in place of what its folder held. Days without lines are left
    as they are. A day's rows are dealt out by SKU over as many files as their number asks for."""
    rows = materialise(daily_partials(detail, params))  # counted, then written: the lines are read once
    sizes = rows.groupBy("day").agg(F.ceil(F.count(F.lit(1)) / F.lit(ROWS_PER_FILE)).cast("int").alias("files"))
    days = sizes.agg(F.count(F.lit(1)).alias("days"), F.sum("files").alias("files")).first()
    if not days["days"]:
        return
    share = F.pmod(F.xxhash64("sku_key"), F.lit(max(1, math.ceil(days["files"] / days["days"]))))
    out = rows.withColumn("_share", share).repartition("day", "_share").drop("_share")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def window_partials(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """Per-SKU sums of the window, from the folders of its days."""
    lo, hi = _days(params)
    days = read_table(spark, path).filter((F.col("day") >= F.lit(lo).cast("date")) & (F.col("day") < F.lit(hi).cast("date")))
    return days.groupBy("sku_key").agg(*[F.sum(c).alias(c) for c in PARTIAL_SUMS])


def features_from_daily(spark: SparkSession, path: str, sku: DataFrame, params: Params) -> DataFrame:
    """The feature table of ``params``' window, equal to ``sku_features_eager`` over the lines of the
    days written so far."""
    return features_from_partials(window_partials(spark, path, params), sku, params)
