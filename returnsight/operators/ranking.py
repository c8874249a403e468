"""Global order statistics without a single-partition window.

``range_index`` gives every row its 0-based position in a total order (and optional running
sums) the way a distributed sort does: range-partition on the order key, sort each range and
stamp each row with (partition, index in the range), checkpoint, count each partition, and turn
those per-partition totals (one row per partition, a bound fixed by the partition count) into
offsets. The checkpoint to the shared folder fixes ranges, tie order and stamps, so the totals
and the rows always agree, even when a lost executor forces a recompute.

The label-encoding dictionary, splits and folds, the ROC running sums and ranks are built on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnsight.session import materialise


_LOCAL_BITS = 33  # monotonically_increasing_id(): partition index above bit 33, row index below


def _ranked(df: DataFrame, order: Sequence[Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition on ``order``, sort each range, stamp every row with its partition index
    (``_part``) and its index inside the sorted range (``_local``), and checkpoint.

    The stamp is ``monotonically_increasing_id()`` taken right after the in-partition sort, so it
    needs no second shuffle; the checkpoint to the shared folder fixes the ranges, the order of
    ties and the stamps, so totals and rows agree even when a lost executor forces a recompute."""
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    stamped = materialise(ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    return stamped.withColumn("_part", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )


def range_index(
    df: DataFrame,
    order: Sequence[Column],
    *,
    sums: Sequence[str] = (),
    following: Sequence[str] = (),
    num_partitions: int | None = None,
    pos_col: str = "_pos",
) -> DataFrame:
    """Add ``pos_col`` (global 0-based position under ``order``), ``_cum_<c>`` (inclusive
    running sum of each column in ``sums``), ``_tot_<c>`` (its grand total), ``_next_<c>`` (the
    column's value in the row that follows, NULL in the last) and ``_rows`` (the number of rows), all
    from the same per-partition totals: a range hands its first values to the range before. ``order`` should be a total order when positions of
    tied rows matter; ranges never split equal keys across partitions.

    Without ``num_partitions`` the range count starts at ``spark.sql.shuffle.partitions`` and
    AQE may coalesce neighbouring ranges of a small input; merged ranges stay contiguous, so
    partition ids remain in key order."""
    tagged = _ranked(df, order, num_partitions)
    totals = tagged.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums],
        *[F.min_by(c, "_local").alias(f"_f_{c}") for c in following],
    )
    # one row per partition: a bound fixed by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        F.sum("_n").over(everything).alias("_rows"),
        *[F.sum(f"_t_{c}").over(everything).alias(f"_tot_{c}") for c in sums],
        *[F.lead(f"_f_{c}").over(Window.orderBy("_part")).alias(f"_over_{c}") for c in following],
    )
    out = tagged.join(F.broadcast(offsets), "_part").withColumn(pos_col, (F.col("_off") + F.col("_local")).cast("long"))
    if sums:
        running = Window.partitionBy("_part").orderBy("_local").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        for c in sums:
            out = out.withColumn(f"_cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(running))
    if following:
        own = Window.partitionBy("_part").orderBy("_local")
        last = F.lead(F.lit(True)).over(own).isNull()
        for c in following:
            out = out.withColumn(f"_next_{c}", F.when(last, F.col(f"_over_{c}")).otherwise(F.lead(c).over(own)))
    return out.drop("_part", "_local", "_mid", "_off", *[f"_o_{c}" for c in sums], *[f"_over_{c}" for c in following])


def dense_codes_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Dictionaries of several string columns with one range shuffle: ``(column_name, category,
    code)``, categories in ascending byte order with NULL last, coded 0..k-1 per column."""
    parts = [df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("category")).distinct() for c in cols]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    ranked = range_index(long, [F.col("column_name").asc(), F.col("category").asc_nulls_last()])
    # first position of each column: one row per column, a bound fixed by the schema
    starts = ranked.groupBy("column_name").agg(F.min("_pos").alias("_start"))
    return ranked.join(F.broadcast(starts), "column_name").select(
        "column_name", "category", (F.col("_pos") - F.col("_start")).cast("int").alias("code")
    )
