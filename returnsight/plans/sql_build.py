"""The feature build as Spark SQL statements over catalog tables, the way the reference runs it:
a line-level intermediate, an idempotent replace of the feature table, the feature-table CTAS
and a final read-back, then the per-product report table the top-5 reports read.

Table names and values are bound, never pasted into the text: tables go through
``IDENTIFIER(:name)`` and the window and threshold are named parameter markers
(``spark.sql(text, args=...)``), so one statement text serves any schema.

The CTAS is written in the aggregate-before-join shape of ``operators.features``: it scans the
line table once and reduces it to one partial row per SKU per map task before the only line-level
shuffle, so a SKU that holds a third of all lines cannot create a hot task. The dimension is
reduced to (group, multiplicity) rows, which keeps the fan-out of duplicate dimension rows. The
intermediate is a temporary view, so nothing at line level is written; the planner inlines it
wherever it is read.
"""

from __future__ import annotations

import datetime as dt
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from returnsight.config import Params
from returnsight.operators.features import detail_flags
from returnsight.plans.publish import publish

TMP_VIEW = "parameters_for_analysis_tmp"

# Per-SKU features. Averages are sum / count of the qualifying lines; a dimension group repeated
# m times scales sums by m and leaves averages unchanged; the sale-line threshold applies to the
# joined line count of the key (sale lines x dimension rows of the key).
FEATURES_SQL = """
WITH lines AS (
  SELECT sku_key, quantity, plu_amt,
         CASE ecom WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS ecom,
         CASE sale WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS sale,
         CASE `return` WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS ret,
         CASE receipted WHEN 'Y' THEN 1 WHEN 'N' THEN 0 END AS receipted
  FROM IDENTIFIER(:detail_table)
  WHERE date_pos >= :date_lo AND date_pos < :date_hi
),
per_sku AS (
  SELECT sku_key,
         sum(ret) AS r_sum, count(ret) AS r_n,
         sum(plu_amt) FILTER (WHERE sale = 1) AS p_sum, count(plu_amt) FILTER (WHERE sale = 1) AS p_n,
         sum(quantity) FILTER (WHERE sale = 1) AS q_sum,
         sum(ecom) FILTER (WHERE sale = 1) AS e_sum, count(ecom) FILTER (WHERE sale = 1) AS e_n,
         sum(receipted) FILTER (WHERE ret = 1) AS c_sum, count(receipted) FILTER (WHERE ret = 1) AS c_n,
         sum(sale) AS sale_lines
  FROM lines
  GROUP BY sku_key
),
dim_groups AS (
  SELECT sku_key, class_desc || ' ' || department_desc AS product_desc,
         split_part(sku_desc, '/', 2) AS sku_color, split_part(sku_desc, '/', 3) AS sku_size,
         sku_cost, count(*) AS m
  FROM IDENTIFIER(:sku_table)
  GROUP BY 1, 2, 3, 4, 5
),
dim_keys AS (
  SELECT sku_key, sum(m) AS key_rows FROM dim_groups GROUP BY sku_key
)
SELECT s.sku_key,
       try_divide(CAST(s.r_sum AS DOUBLE), CAST(s.r_n AS DOUBLE)) AS return_rate,
       g.product_desc, g.sku_color, g.sku_size, g.sku_cost,
       try_divide(s.p_sum, CAST(s.p_n AS DOUBLE)) AS avg_price_product,
       s.q_sum * g.m AS quantity,
       try_divide(CAST(s.e_sum AS DOUBLE), CAST(s.e_n AS DOUBLE)) AS ecom_rate,
       try_divide(CAST(s.c_sum AS DOUBLE), CAST(s.c_n AS DOUBLE)) AS receipted_rate
FROM per_sku AS s
JOIN dim_groups AS g ON s.sku_key = g.sku_key
JOIN dim_keys AS k ON s.sku_key = k.sku_key
WHERE s.sale_lines * k.key_rows > :min_sale_lines
"""

# Per-product report table read by the top-5 reports.
REPORT_SQL = """
SELECT product_desc,
       avg(return_rate) AS avg_return_rate,
       avg(ecom_rate) AS avg_ecom_rate,
       avg(quantity) AS avg_quantity,
       sum(quantity) AS tot_quantity
FROM IDENTIFIER(:feature_table)
GROUP BY product_desc
"""

# Top-k products by average return rate among those whose text matches a pattern (ties by text).
TOP_SQL = """
SELECT product_desc, avg_return_rate, avg_ecom_rate
FROM IDENTIFIER(:report_table)
WHERE coalesce(product_desc RLIKE :pattern, false)
ORDER BY avg_return_rate DESC NULLS LAST, product_desc
LIMIT :k
"""


def _date(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _check_format(fmt: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", fmt):
        raise ValueError(f"bad table format {fmt!r}")
    return fmt


def _feature_args(params: Params, detail_table: str, sku_table: str) -> dict:
    return {
        "detail_table": detail_table, "sku_table": sku_table,
        "date_lo": _date(params.date_lo), "date_hi": _date(params.date_hi),
        "min_sale_lines": params.min_sale_lines,
    }


def reference_tables(schema: str) -> dict[str, str]:
    """The reference's table names in one schema (inputs, feature table, report table)."""
    return {
        "detail_table": f"{schema}.std_clnt_detail",
        "sku_table": f"{schema}.std_clnt_sku",
        "feature_table": f"{schema}.parameters_for_analysis_cln",
        "report_table": f"{schema}.plot_1",
    }


def line_table(spark: SparkSession, params: Params, detail_table: str, sku_table: str) -> DataFrame:
    """The line-level intermediate, registered as the temporary view ``parameters_for_analysis_tmp``."""
    df = detail_flags(spark.table(detail_table), spark.table(sku_table), params)
    df.createOrReplaceTempView(TMP_VIEW)
    return df


def build_feature_table(
    spark: SparkSession,
    params: Params,
    *,
    detail_table: str,
    sku_table: str,
    feature_table: str,
    fmt: str = "parquet",
    **_: str,
) -> DataFrame:
    """Run the script: intermediate view, drop, CTAS, read-back. Rerunnable (the target is
    dropped first). Returns the read-back of the written table."""
    line_table(spark, params, detail_table, sku_table)
    # as the reference replaces it; publish_tables leaves readers no gap
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:t)", args={"t": feature_table})
    spark.sql(
        f"CREATE TABLE IDENTIFIER(:target) USING {_check_format(fmt)} AS {FEATURES_SQL}",
        args={"target": feature_table} | _feature_args(params, detail_table, sku_table),
    )
    return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": feature_table})


def build_report_table(
    spark: SparkSession, *, feature_table: str, report_table: str, fmt: str = "parquet", **_: str
) -> DataFrame:
    """Per-product summary table (``product_desc``, average return and online rates, average and
    total units), replaced on rerun; returns its read-back."""
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:t)", args={"t": report_table})
    spark.sql(
        f"CREATE TABLE IDENTIFIER(:target) USING {_check_format(fmt)} AS {REPORT_SQL}",
        args={"target": report_table, "feature_table": feature_table},
    )
    return spark.sql("SELECT * FROM IDENTIFIER(:t)", args={"t": report_table})


def publish_tables(
    spark: SparkSession, params: Params, root: str, *, detail_table: str, sku_table: str, feature_table: str, report_table: str, keep: int = 2
) -> None:
    """Feature and report table by the same statements, as views that are switched to a new version
    under ``root`` once it is complete: readers always find a table, and a failed build changes nothing.
    The names must not be taken by tables."""
    features = spark.sql(FEATURES_SQL, args=_feature_args(params, detail_table, sku_table))
    publish(features, feature_table, f"{root}/features", keep=keep)
    publish(spark.sql(REPORT_SQL, args={"feature_table": feature_table}), report_table, f"{root}/report", keep=keep)


def top_products(spark: SparkSession, report_table: str, pattern: str, k: int) -> DataFrame:
    """Top ``k`` rows of the report table whose product text matches ``pattern``
    (case-insensitive, Unicode case rules)."""
    return spark.sql(TOP_SQL, args={"report_table": report_table, "pattern": f"(?iu){pattern}", "k": k})


def fixture_tables(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Table names for the test tables: the mapped line and SKU inputs as temporary views, and
    output tables in a schema of this call's own, so builds do not disturb each other; its location is a folder under the session's checkpoint folder,
    so managed tables written there land in shared storage, never in a machine-local path."""
    from returnsight.session import ensure_checkpoint_dir
    from returnsight.sources import fixture_detail, fixture_sku

    folder = sf_dir.rstrip("/")
    tag = re.sub(r"[^A-Za-z0-9]", "_", os.path.basename(folder))
    schema = f"returnsight_{tag}_{uuid.uuid4().hex[:12]}"
    location = os.path.join(ensure_checkpoint_dir(spark), f"{schema}.db").replace("'", "")
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{location}'")
    fixture_detail(spark, sf_dir).createOrReplaceTempView(f"{schema}_std_clnt_detail")
    fixture_sku(spark, sf_dir).createOrReplaceTempView(f"{schema}_std_clnt_sku")
    tables = reference_tables(schema)
    tables.update(detail_table=f"{schema}_std_clnt_detail", sku_table=f"{schema}_std_clnt_sku")
    return tables
