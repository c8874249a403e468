"""Per-product report and top-k tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.functions import icontains


def product_summary(features: DataFrame) -> DataFrame:
    """One row per product description: mean return and online rates, mean and total units."""
    return features.groupBy("product_desc").agg(
        F.avg("return_rate").alias("avg_return_rate"),
        F.avg("ecom_rate").alias("avg_ecom_rate"),
        F.avg("quantity").alias("avg_quantity"),
        F.sum("quantity").alias("tot_quantity"),
    )


def matching(df: DataFrame, pattern: str, col: str = "product_desc") -> DataFrame:
    return df.filter(icontains(col, pattern))


def top_k(df: DataFrame, k: int, by: str = "avg_return_rate", tie: str = "product_desc") -> DataFrame:
    """The k largest by ``by`` (missing last), ties broken by ``tie``; planned as a per-partition
    top-k (TakeOrderedAndProject), so only k rows per partition travel."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc_nulls_last()).limit(k)


def preview(df: DataFrame, n: int = 10, key: str = "sku_key") -> DataFrame:
    return df.orderBy(key).limit(n)
