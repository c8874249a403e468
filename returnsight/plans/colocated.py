"""Lines and SKU dimension written side by side, bucketed and sorted by SKU.

Written once, both tables answer every later feature build and semi-join without moving a line: their
buckets already hold the rows that a join or an aggregation by SKU needs together. The hot SKU keeps
its bucket, so where one SKU holds a large share of the lines the aggregate-before-join form over the
plain table is the better plan; ``largest_bucket_share`` tells."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.functions import decode_flag
from returnsight.operators.features import FEATURE_COLUMNS, GROUP_KEYS, decoded_lines, dimension_attributes, feature_aggregates, in_window
from returnsight.sources import write_table


@dataclass(frozen=True)
class Colocated:
    """Names of the two bucketed catalog tables."""

    lines: str
    sku: str


def write_colocated(detail: DataFrame, sku: DataFrame, prefix: str, buckets: int) -> Colocated:
    """Write both inputs, columns unchanged, as ``<prefix>_lines`` and ``<prefix>_sku``. Lines are dealt
    out by bucket before they are written, so that each bucket is one file."""
    names = Colocated(f"{prefix}_lines", f"{prefix}_sku")
    for df, name in ((detail, names.lines), (sku, names.sku)):
        write_table(df.repartition(buckets, "sku_key"), name, as_table=True, bucket_by=(buckets, "sku_key"))
    return names


def colocated_active_skus(spark: SparkSession, tables: Colocated, params: Params) -> DataFrame:
    """SKUs with more than the threshold of sale lines, counted bucket by bucket."""
    sold = in_window(spark.table(tables.lines), params).groupBy("sku_key").agg(F.sum(decode_flag("sale")).cast("long").alias("sold"))
    rows = spark.table(tables.sku).groupBy("sku_key").agg(F.count(F.lit(1)).alias("key_rows"))
    counted = sold.join(rows.hint("merge"), "sku_key").select("sku_key", (F.col("sold") * F.col("key_rows")).alias("sale_lines"))
    return counted.filter(F.col("sale_lines") > F.lit(params.min_sale_lines))


def colocated_features(spark: SparkSession, tables: Colocated, params: Params) -> DataFrame:
    """The feature table in the reference's shape: lines joined to the dimension, kept where the SKU is
    active, aggregated by the five keys. Merge joins keep the buckets' order, and none needs a
    shuffle."""
    lines = decoded_lines(spark.table(tables.lines), params)
    joined = lines.join(dimension_attributes(spark.table(tables.sku)).hint("merge"), "sku_key", "inner")
    active = colocated_active_skus(spark, tables, params).select("sku_key")
    return joined.join(active.hint("merge"), "sku_key", "left_semi").groupBy(*GROUP_KEYS).agg(*feature_aggregates()).select(*FEATURE_COLUMNS)


def largest_bucket_share(spark: SparkSession, tables: Colocated, buckets: int) -> float:
    """Share of the lines in the fullest bucket; 1 / ``buckets`` is even."""
    bucket = F.pmod(F.hash("sku_key"), F.lit(buckets))
    sizes = spark.table(tables.lines).groupBy(bucket.alias("bucket")).count().agg((F.max("count") / F.sum("count")).alias("share"))
    return float(sizes.first()["share"] or 0.0)
