"""Sinks: idempotent replace of a materialised table (CTAS + DROP IF EXISTS)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    target: str,
    *,
    fmt: str = "parquet",
    as_table: bool = False,
    partition_by: list[str] | None = None,
    bucket_by: tuple[int, str] | None = None,
) -> None:
    """Overwrite ``target`` (a path, or a catalog table when ``as_table``).

    ``bucket_by=(n, 'sku_key')`` writes a bucketed catalog table so later joins and
    aggregations on the key read co-located buckets without a shuffle.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        if not as_table:
            raise ValueError("bucketing needs a catalog table (as_table=True)")
        n, col = bucket_by
        writer = writer.bucketBy(n, col).sortBy(col)
    if as_table:
        writer.saveAsTable(target)
    else:
        writer.save(target)
