"""Scans.

Production inputs are a transaction-line fact table and a SKU dimension (any format Spark
reads, a catalog table, or a database over JDBC). The driver's test tables are TPC-H-shaped,
so ``fixture_detail`` / ``fixture_sku`` derive the two inputs from ``lineitem``, ``orders`` and
``part`` with plain column expressions; Catalyst prunes the columns a query does not use and
pushes the date window into the ``orders`` scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, source: str, fmt: str = "parquet", **options) -> DataFrame:
    """A catalog table name (``fmt='table'``) or a path in any Spark file format."""
    if fmt == "table":
        return spark.table(source)
    return spark.read.format(fmt).options(**options).load(source)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    num_partitions: int | None = None,
    properties: dict | None = None,
) -> DataFrame:
    """Parallel JDBC scan: with a numeric partition column, ``num_partitions`` range queries run
    on the executors instead of one connection pulling the whole table into one process."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower_bound)
            .option("upperBound", upper_bound)
            .option("numPartitions", num_partitions)
        )
    return reader.load()


def _yn(cond: Column) -> Column:
    return F.when(cond, F.lit("Y")).otherwise(F.lit("N"))


def fixture_detail(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """Transaction lines: one row per ``lineitem`` row with its order's date and priority.

    ``receipted`` is NULL when ``l_tax = 0`` so that the flag decode sees values outside Y/N.
    ``lineitem`` may be a streaming DataFrame (a stream-static join with ``orders``).
    """
    li = lineitem if lineitem is not None else read_parquet_table(spark, sf_dir, "lineitem")
    od = read_parquet_table(spark, sf_dir, "orders")
    joined = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    returned = F.col("l_returnflag") == "R"
    return joined.select(
        F.col("l_partkey").alias("sku_key"),
        F.col("l_quantity").alias("quantity"),
        F.try_divide("l_extendedprice", "l_quantity").alias("plu_amt"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("tran_discount_amt"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("override_amt"),
        (F.col("l_extendedprice") * (F.lit(1) - F.col("l_discount"))).alias("extended_amt"),
        _yn(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("ecom"),
        F.when(returned, F.lit("N")).otherwise(F.lit("Y")).alias("sale"),
        _yn(returned).alias("return"),
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string"))
        .when(F.col("l_linestatus") == "F", F.lit("Y"))
        .otherwise(F.lit("N"))
        .alias("receipted"),
        F.col("o_orderdate").alias("date_pos"),
    )


def fixture_sku(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SKU dimension from ``part``; ``sku_desc`` is 'brand/first word of name/size' and the size
    is empty for every tenth size value, which exercises the empty category."""
    p = read_parquet_table(spark, sf_dir, "part")
    size = F.when(F.col("p_size") % 10 == 0, F.lit("")).otherwise(F.col("p_size").cast("string"))
    return p.select(
        F.col("p_partkey").alias("sku_key"),
        F.col("p_type").alias("class_desc"),
        F.col("p_name").alias("department_desc"),
        (F.col("p_retailprice") * F.lit(0.6)).alias("sku_cost"),
        F.concat(
            F.col("p_brand"), F.lit("/"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.lit("/"), size
        ).alias("sku_desc"),
    )


@dataclass(frozen=True)
class Source:
    """Where the two inputs come from: the TPC-H-shaped test tables of ``sf_dir`` (mapped by
    ``fixture_detail`` / ``fixture_sku``), or production line and SKU tables with the reference's
    column names, given as paths (any Spark format), catalog table names (``fmt='table'``) or tables
    of the database at ``url`` (``fmt='jdbc'``; ``partition`` = (column, lowest, highest, number of
    range queries) reads the lines in parallel). ``daily`` is a folder of daily sums
    (``plans.daily``) that stands in for the lines."""

    sf_dir: str | None = None
    detail: str | None = None
    sku: str | None = None
    fmt: str = "parquet"
    url: str | None = None
    partition: tuple[str, int, int, int] | None = None
    daily: str | None = None

    def lines(self, spark: SparkSession) -> DataFrame:
        """What a feature build reads besides the dimension: the lines, or their daily sums."""
        return read_table(spark, self.daily) if self.daily is not None else self.load(spark)[0]

    def dimension(self, spark: SparkSession) -> DataFrame:
        if self.daily is None or self.sf_dir is not None:
            return fixture_sku(spark, self.sf_dir) if self.sf_dir is not None else self.load(spark)[1]
        return read_table(spark, self.sku, self.fmt)

    def load(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        if self.sf_dir is not None:
            return fixture_detail(spark, self.sf_dir), fixture_sku(spark, self.sf_dir)
        if self.detail is None or self.sku is None:
            raise ValueError("a Source needs sf_dir, or both detail and sku")
        if self.fmt == "jdbc":
            if self.url is None:
                raise ValueError("a database source needs its url")
            column, low, high, n = self.partition or (None, None, None, None)
            lines = read_jdbc(spark, self.url, self.detail, partition_column=column, lower_bound=low, upper_bound=high, num_partitions=n)
            return lines, read_jdbc(spark, self.url, self.sku)
        return read_table(spark, self.detail, self.fmt), read_table(spark, self.sku, self.fmt)

    def paths(self) -> list[str] | None:
        """Files or folders that the inputs are read from; None for catalog and database tables."""
        own = [] if self.daily is None else [self.daily]
        if self.sf_dir is not None:
            return [*own, *(f"{self.sf_dir.rstrip('/')}/{name}.parquet" for name in ("lineitem", "orders", "part"))]
        return None if self.fmt in ("jdbc", "table") else [*own, *(p for p in (self.detail, self.sku) if p is not None)]


def as_source(source: "str | Source") -> Source:
    return source if isinstance(source, Source) else Source(sf_dir=source)
