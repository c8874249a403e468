"""Feature build: transaction lines + SKU dimension -> one feature row per SKU.

Two equivalent plans are provided.

``sku_features`` follows the reference's statement structure: decode flags on every joined line,
keep SKUs whose sale-line count passes the threshold (a left-semi join, which Catalyst pushes
below the dimension join), then aggregate by the five group keys.

``sku_features_eager`` aggregates the lines per ``sku_key`` *before* the dimension join. The hot
path then is one scan and one hash aggregation with map-side partial aggregation, so a SKU that
holds a third of all lines reaches the shuffle as one partial row per map task; the join that
follows is one row per SKU on each side, so it cannot skew. Dimension duplicates keep the
reference's fan-out semantics through a multiplicity count: averages are unchanged by it, sums
and the threshold scale by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.functions import decode_flag
from returnsight.session import materialise

GROUP_KEYS = ["sku_key", "product_desc", "sku_color", "sku_size", "sku_cost"]
FEATURE_COLUMNS = [
    "sku_key", "return_rate", "product_desc", "sku_color", "sku_size", "sku_cost",
    "avg_price_product", "quantity", "ecom_rate", "receipted_rate",
]


def in_window(detail: DataFrame, params: Params) -> DataFrame:
    """Half-open date window on the raw column, so the comparison reaches the scan as a pushed filter."""
    d = F.col("date_pos")
    return detail.filter((d >= F.lit(params.date_lo).cast("timestamp_ntz")) & (d < F.lit(params.date_hi).cast("timestamp_ntz")))


def dimension_attributes(sku: DataFrame) -> DataFrame:
    """Derived SKU attributes: 'class department', and color / size from the '/'-separated description."""
    return sku.select(
        "sku_key",
        F.concat(F.col("class_desc"), F.lit(" "), F.col("department_desc")).alias("product_desc"),
        "sku_cost",
        F.split_part(F.col("sku_desc"), F.lit("/"), F.lit(2)).alias("sku_color"),
        F.split_part(F.col("sku_desc"), F.lit("/"), F.lit(3)).alias("sku_size"),
    )


def decoded_lines(detail: DataFrame, params: Params, *extra: Column) -> DataFrame:
    return in_window(detail, params).select(
        *extra,
        "sku_key", "quantity", "plu_amt", "tran_discount_amt", "override_amt", "extended_amt",
        decode_flag("ecom").alias("ecom"),
        decode_flag("sale").alias("sale"),
        decode_flag("return").alias("return"),
        decode_flag("receipted").alias("receipted"),
    )


# A SKU dimension up to this many rows and bytes of derived attributes is broadcast to the
# line-level join; a larger one is left to the planner.
BROADCAST_DIMENSION_ROWS = 1_000_000
BROADCAST_DIMENSION_BYTES = 100 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes, measured in one aggregation, are within
    the bounds."""
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    width = sum(text, F.lit(16 * len(df.columns))).cast("long")
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    small = size["n"] <= BROADCAST_DIMENSION_ROWS and (size["bytes"] or 0) <= BROADCAST_DIMENSION_BYTES
    return F.broadcast(df) if small else df


# AQE refuses to split a skewed join partition if the split costs a shuffle above it, as it does
# when the aggregation above groups by the join key; a key with a third of all lines needs it.
FORCE_SKEW_SPLIT = "spark.sql.adaptive.forceOptimizeSkewedJoin"


def force_skew_split(df: DataFrame) -> None:
    """Turn the option on for the frame's session, unless the user has set it."""
    conf = df.sparkSession.conf
    if conf.get(FORCE_SKEW_SPLIT, "false") == "false":
        conf.set(FORCE_SKEW_SPLIT, "true")


def detail_flags(detail: DataFrame, sku: DataFrame, params: Params) -> DataFrame:
    """The intermediate line table: windowed lines joined to the dimension, flags decoded.

    Up to the broadcast bounds the dimension is broadcast, so the line table is never shuffled for
    this join and a SKU holding a third of the lines stays in its map tasks. Beyond them it is a
    sort-merge join on ``sku_key`` whose skewed partitions AQE splits.
    """
    force_skew_split(detail)
    j = decoded_lines(detail, params).join(broadcast_if_small(dimension_attributes(sku)), "sku_key", "inner")
    return j.select(
        "sku_key", "quantity", "plu_amt", "tran_discount_amt", "override_amt", "extended_amt",
        "ecom", "sale", "return", "receipted", "product_desc", "sku_cost", "sku_color", "sku_size",
    )


def active_skus(detail: DataFrame, sku: DataFrame, params: Params) -> DataFrame:
    """SKUs with more than ``min_sale_lines`` sale *lines* (not units) joined to the dimension.

    Sale lines and dimension rows are counted per key before they meet, so a key with a third of the
    lines crosses the shuffle as one partial row per map task."""
    lines = in_window(detail, params).select("sku_key", decode_flag("sale").alias("sale"))
    sold = lines.groupBy("sku_key").agg(F.sum("sale").cast("long").alias("sold"))
    rows = sku.groupBy("sku_key").agg(F.count(F.lit(1)).alias("key_rows"))
    counted = sold.join(rows, "sku_key").select("sku_key", (F.col("sold") * F.col("key_rows")).alias("sale_lines"))
    return counted.filter(F.col("sale_lines") > F.lit(params.min_sale_lines))


def feature_aggregates() -> list[Column]:
    sale = F.col("sale") == 1
    ret = F.col("return") == 1
    return [
        F.avg("return").alias("return_rate"),
        F.avg(F.when(sale, F.col("plu_amt"))).alias("avg_price_product"),
        F.sum(F.when(sale, F.col("quantity"))).alias("quantity"),
        F.avg(F.when(sale, F.col("ecom"))).alias("ecom_rate"),
        F.avg(F.when(ret, F.col("receipted"))).alias("receipted_rate"),
    ]


def sku_features(detail: DataFrame, sku: DataFrame, params: Params) -> DataFrame:
    """Semi-join form: joined lines of active SKUs, aggregated by the five group keys.

    The active set (one row per SKU at most) is checkpointed and measured; up to the broadcast bounds
    it is broadcast to the semi-join, so lines are never shuffled for it; a larger set is joined by
    sort-merge with AQE's skew split."""
    tmp = detail_flags(detail, sku, params)
    active = broadcast_if_small(materialise(active_skus(detail, sku, params).select("sku_key")))
    out = tmp.join(active, "sku_key", "left_semi").groupBy(*GROUP_KEYS).agg(*feature_aggregates())
    return out.select(*FEATURE_COLUMNS)


def _line_sums() -> list[Column]:
    sale = F.col("sale") == 1
    ret = F.col("return") == 1
    price = F.when(sale, F.col("plu_amt"))
    ecom = F.when(sale, F.col("ecom"))
    rcpt = F.when(ret, F.col("receipted"))
    return [
        F.sum("return").alias("r_sum"), F.count("return").alias("r_n"),
        F.sum(price).alias("p_sum"), F.count(price).alias("p_n"),
        F.sum(F.when(sale, F.col("quantity"))).alias("q_sum"),
        F.sum(ecom).alias("e_sum"), F.count(ecom).alias("e_n"),
        F.sum(rcpt).alias("c_sum"), F.count(rcpt).alias("c_n"),
        F.sum("sale").alias("sale_lines"),
    ]


#: Columns of the partial sums; each adds up over disjoint sets of lines.
PARTIAL_SUMS = ["r_sum", "r_n", "p_sum", "p_n", "q_sum", "e_sum", "e_n", "c_sum", "c_n", "sale_lines"]


def line_partials(detail: DataFrame, params: Params) -> DataFrame:
    """Per-SKU partial sums and counts of the windowed, decoded lines (one row per ``sku_key``).

    Sums and counts merge associatively, so this is also the state a streaming query keeps."""
    return decoded_lines(detail, params).groupBy("sku_key").agg(*_line_sums())


def daily_line_partials(detail: DataFrame, params: Params) -> DataFrame:
    """The same sums per (day, SKU)."""
    lines = decoded_lines(detail, params, F.to_date("date_pos").alias("day"))
    return lines.groupBy("day", "sku_key").agg(*_line_sums())


def features_from_partials(per_sku: DataFrame, sku: DataFrame, params: Params) -> DataFrame:
    """Join per-SKU partials to the dimension, apply the sale-line threshold, finish the means."""
    # Dimension rows per group (m) and per key (key_rows), both by partial + final aggregation
    # and a join rather than a per-key window, so a key that holds a third of the dimension is
    # pre-reduced on the map side and a skewed join partition can still be split by AQE.
    groups = dimension_attributes(sku).groupBy(*GROUP_KEYS).agg(F.count(F.lit(1)).alias("m"))
    per_key = groups.groupBy("sku_key").agg(F.sum("m").alias("key_rows"))
    dim = groups.join(per_key, "sku_key", "inner")
    j = per_sku.join(dim, "sku_key", "inner").filter(F.col("sale_lines") * F.col("key_rows") > F.lit(params.min_sale_lines))

    def mean(s: str, n: str) -> Column:
        # avg over m copies of each line = sum / count; NULL when no line qualifies
        return F.try_divide(F.col(s).cast("double"), F.col(n).cast("double"))

    return j.select(
        "sku_key",
        mean("r_sum", "r_n").alias("return_rate"),
        "product_desc", "sku_color", "sku_size", "sku_cost",
        mean("p_sum", "p_n").alias("avg_price_product"),
        (F.col("q_sum") * F.col("m")).alias("quantity"),
        mean("e_sum", "e_n").alias("ecom_rate"),
        mean("c_sum", "c_n").alias("receipted_rate"),
    )


def sku_features_eager(detail: DataFrame, sku: DataFrame, params: Params) -> DataFrame:
    """Aggregate-before-join form; reads the line table once and cannot skew on a hot SKU."""
    return features_from_partials(line_partials(detail, params), sku, params)
