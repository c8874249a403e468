"""Categories in the order of their label means, for splits on columns of any number of categories.

A boosted tree splits best on a category column at a cut of the categories ordered by their label
mean. The means come from one aggregation over the training rows, smoothed towards the mean of all
rows so that rare categories stay near the middle, and the place in that order takes the code's part
as an ordinary number. A code that training has not seen takes the place of the overall mean."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.operators.features import broadcast_if_small
from returnsight.operators.ranking import range_index

#: Rows of the overall mean that are added to every category.
SMOOTHING = 10.0


def category_sums(df: DataFrame, cols: Sequence[str], label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column_name, code, n, positives)``: one aggregation for all columns; a category held by
    a third of the rows leaves each map task as one row."""
    long = df.select(*by, F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in cols])
    long = long.unpivot([*by, "_y"], list(cols), "column_name", "code")
    return long.groupBy(*by, "column_name", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("positives"))


def training_sums(sums: DataFrame, n_folds: int, by: str = "dataset") -> DataFrame:
    """From the sums of each fold, those of its training rows, which are all other folds': the totals
    less the fold's own. Categories that occur in the fold alone are left out."""
    total = sums.groupBy(by, "column_name", "code").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))
    total = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    own = sums.select(F.col(by).alias("_by"), F.col("fold").alias("_fold"), F.col("column_name").alias("_column"), F.col("code").alias("_code"), F.col("n").alias("_n"), F.col("positives").alias("_p"))
    same = (F.col(by) == F.col("_by")) & (F.col("fold") == F.col("_fold")) & (F.col("column_name") == F.col("_column")) & F.col("code").eqNullSafe(F.col("_code"))
    left = total.join(own, same, "left")
    n, positives = F.col("n") - F.coalesce("_n", F.lit(0)), F.col("positives") - F.coalesce("_p", F.lit(0.0))
    return left.select(by, "fold", "column_name", "code", n.alias("n"), positives.alias("positives")).filter("n > 0")


def category_order(sums: DataFrame, by: Sequence[str] = (), smoothing: float = SMOOTHING) -> DataFrame:
    """``(*by, column_name, code, n, label_mean, place, unseen)``: places 0, 1, ... by rising smoothed
    label mean within each column, equal means by code; ``unseen`` is the place, between two others, of
    a code that does not occur. One range shuffle ranks all columns."""
    keys = [*by, "column_name"]
    overall = sums.groupBy(*keys).agg((F.sum("positives") / F.sum("n").cast("double")).alias("overall"))  # a row per column (and fold)
    means = sums.join(F.broadcast(overall), keys).withColumn("label_mean", (F.col("positives") + F.lit(smoothing) * F.col("overall")) / (F.col("n").cast("double") + F.lit(smoothing)))
    ranked = range_index(means, [*[F.col(k).asc() for k in keys], F.col("label_mean").asc(), F.col("code").asc_nulls_last()])
    starts = ranked.groupBy(*keys).agg(F.min("_pos").alias("_start"), (F.count_if(F.col("label_mean") < F.col("overall")) - 0.5).cast("double").alias("unseen"))
    place = (F.col("_pos") - F.col("_start")).cast("int").alias("place")
    return ranked.join(F.broadcast(starts), keys).select(*keys, "code", "n", "label_mean", place, "unseen")


@dataclass(frozen=True)
class CategoryOrder:
    """Places of the categories of each column, and where codes without one stand."""

    places: dict[str, DataFrame]  # column -> (_code, _place), with a broadcast hint if small
    unseen: dict[str, float]
    categories: dict[str, int]

    def apply(self, df: DataFrame) -> DataFrame:
        for c, known in self.places.items():
            out = [F.coalesce(F.col("_place").cast("double"), F.lit(self.unseen[c])).alias(c) if f == c else F.col(f"`{f}`") for f in df.columns]
            df = df.join(known, df[c].cast("double").eqNullSafe(known["_code"]), "left").select(*out)
        return df


def learned_order(order: DataFrame) -> CategoryOrder:
    """What scoring needs of ``category_order``'s rows of one training set."""
    sizes = order.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.max("unseen").alias("unseen")).collect()
    places = {r["column_name"]: broadcast_if_small(order.filter(F.col("column_name") == r["column_name"]).select(F.col("code").alias("_code"), F.col("place").alias("_place"))) for r in sizes}
    return CategoryOrder(places, {r["column_name"]: r["unseen"] for r in sizes}, {r["column_name"]: r["n"] for r in sizes})
