"""Classifiers on the prepared per-SKU frame with Spark ML.

Hyper-parameters mirror the reference's (boosted trees: rate 0.09, depth 3, 100 rounds,
seed 42; forest: 100 trees of depth 3; logistic regression: L2 with C = 1, which on Spark's
mean-loss objective is ``regParam = 1 / n_train``).

Columns named as ``categories`` are split in the order of their categories' label means in the
training rows (``operators.ordering``), whatever their number. Missing predictors stay in: boosted
trees see a code below the training minimum, so a split can send missing rows either way from the
observed ones; forests and the linear model see the training mean. Orders, codes and means are part
of the fitted model.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.functions import nan_to_null
from returnsight.operators.ordering import CategoryOrder, category_order, category_sums, learned_order, training_sums
from returnsight.operators.split import fold_assignment, holdout_split
from returnsight.plans import boosting, logistic
from returnsight.session import ensure_checkpoint_dir, materialise


@dataclass(frozen=True)
class Fitted:
    """A model with what its input needs: column order, values for missing ones, category places."""

    kind: str
    model: Model | None
    cols: list[str]
    fill: dict[str, float]
    order: CategoryOrder | None = None

    def filled(self, df: DataFrame) -> DataFrame:
        """The predictors as the model sees them."""
        df = fill_missing(df, self.fill)
        return self.order.apply(df) if self.order else df

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assemble(self.filled(df), self.cols))


def fill_missing(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(v)) for c, v in fill.items()})


def missing_values(kind: str, train: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Per column, in one aggregation: a value below the training minimum by one, or by the range if
    that is larger (boosted trees), or the training mean; 0 for a column without any value."""
    x = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    if kind == "GBT":
        row = train.agg(*[F.struct(F.min(x[c]).alias("lo"), F.max(x[c]).alias("hi")).alias(c) for c in cols]).first()
        return {c: 0.0 if row[c]["lo"] is None else row[c]["lo"] - max(1.0, row[c]["hi"] - row[c]["lo"]) for c in cols}
    row = train.agg(*[F.avg(x[c]).alias(c) for c in cols]).first()
    return {c: row[c] or 0.0 for c in cols}


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)


def estimator(kind: str, p: Params, n_train: int, max_bins: int = 32):
    if kind == "GBT":
        return GBTClassifier(
            featuresCol="features", labelCol="label", stepSize=p.gbt_step, maxDepth=p.gbt_depth,
            maxIter=p.gbt_iters, seed=p.gbt_seed, maxBins=max(32, max_bins), checkpointInterval=p.gbt_checkpoint_interval,
        )
    if kind == "RF":
        return RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=p.rf_trees, maxDepth=p.rf_depth,
            featureSubsetStrategy="sqrt", seed=p.rf_seed, maxBins=max(32, max_bins),
        )
    if kind == "LR":
        return LogisticRegression(
            featuresCol="features", labelCol="label", regParam=1.0 / max(n_train, 1),
            elasticNetParam=0.0, standardization=False, maxIter=p.lr_iters,
        )
    raise ValueError(f"unknown model {kind!r}; expected GBT, RF or LR")


#: Rows of a training frame that are fitted in one partition: boosting is a chain of small jobs, whose
#: tasks cost more than the rows of a frame of this size.
ONE_PARTITION_ROWS = 100_000
#: Bins of a numeric column, and of category places, at most.
BINS, PLACE_BINS = 32, 256


def tree_bins(categories: Sequence[int]) -> int:
    """Bins of boosted trees whose ordered columns have so many categories each."""
    return min(PLACE_BINS, max([BINS, *categories]))


def fit(kind: str, train: DataFrame, cols: Sequence[str], p: Params, *, categories: Sequence[str] = (), order: CategoryOrder | None = None) -> Fitted:
    """Fit on a frame holding ``label`` and the predictor columns (doubles). ``order`` is the category
    order of these training rows, if it is known already; else it is learned here and written: every
    task of every round would carry the plan it comes from. Boosted trees beyond ``ONE_PARTITION_ROWS``
    take a partition per core at most."""
    cols = list(cols)
    ordered = [c for c in categories if c in cols and kind == "GBT"]
    n = train.count() if kind in ("GBT", "LR") else 0
    fill = missing_values(kind, train, [c for c in cols if c not in ordered])
    if ordered and order is None:
        order = learned_order(materialise(category_order(category_sums(train, ordered))))
    fitted = Fitted(kind, None, cols, fill, order if ordered else None)
    bins = tree_bins(order.categories.values() if ordered else [])
    data = assemble(fitted.filled(train), cols)
    if kind == "GBT":
        data = data.coalesce(1 if n <= ONE_PARTITION_ROWS else train.sparkSession.sparkContext.defaultParallelism)
    return replace(fitted, model=estimator(kind, p, n, bins).fit(data))


def predict(fitted: Fitted, df: DataFrame, key: str = "sku_key", extra: Sequence[str] = ()) -> DataFrame:
    """``key, label, prediction (int), probability (class 1)`` and the ``extra`` columns."""
    return fitted.transform(df).select(
        key, F.col("label").cast("int").alias("label"),
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("probability"),
        *extra,
    )


def split(df: DataFrame, p: Params) -> DataFrame:
    return holdout_split(df, "sku_key", p.test_fraction, p.split_seed)


def importances(fitted: Fitted) -> DataFrame:
    """Impurity-decrease importance per feature (normalised to sum 1)."""
    vals = fitted.model.featureImportances.toArray().tolist()
    s = SparkSession.getActiveSession()
    return s.createDataFrame([(c, float(v)) for c, v in zip(fitted.cols, vals, strict=True)], "feature string, importance double")


def node_table(fitted: Fitted) -> list:
    """The trees' nodes, read from Spark ML's own persistence; bounded by the model, not the data.
    The written copy is removed."""
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    fitted.model.write().overwrite().save(path)
    try:
        return spark.read.parquet(os.path.join(path, "data")).select(
            F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"),
            F.col("nodeData.prediction").alias("prediction"), F.col("nodeData.impurityStats").alias("stats"),
            F.col("nodeData.rawCount").alias("count"),
            F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"),
            F.col("nodeData.split.leftCategoriesOrThreshold").alias("split"),
            F.col("nodeData.split.numCategories").alias("ncat"),
        ).collect()
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def split_counts(fitted: Fitted) -> DataFrame:
    """How often each feature is used in a split across all trees."""
    used = [r["feature"] for r in node_table(fitted) if r["left"] >= 0]
    rows = [(c, used.count(i)) for i, c in enumerate(fitted.cols)]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, split_count long")


def eval_history(fitted: Fitted, train: DataFrame, test: DataFrame, every: int = 10) -> DataFrame:
    """Mean log-loss after every ``every``-th boosting round on train and test. Spark's loss of
    margin m and label +-1 is 2 log(1 + exp(-2 y m)), twice the log-loss of its probabilities."""
    losses = [fitted.model.evaluateEachIteration(assemble(fitted.filled(d), fitted.cols)) for d in (train, test)]
    rows = [(i, float(a) / 2, float(b) / 2) for i, (a, b) in enumerate(zip(*losses, strict=True), 1) if i % every == 0]
    return SparkSession.getActiveSession().createDataFrame(rows, "iteration int, train_loss double, test_loss double")


def cv_scores(
    kind: str,
    frames: dict[str, DataFrame],
    cols: Sequence[str],
    p: Params,
    *,
    categories: Sequence[str] = (),
    parallelism: int | None = None,
) -> dict[str, list[float]]:
    """k-fold accuracy per named frame: fit on the other folds, score the held-out fold. Folds are
    balanced (hash order of the key) and written once for all fits. Logistic regressions, and boosted
    trees, of all folds and frames are fitted together (``plans.logistic``, ``plans.boosting``), with the
    category orders of all folds learned in one aggregation beforehand; forests are submitted
    concurrently, so Spark schedules their jobs side by side."""
    cores = next(iter(frames.values())).sparkSession.sparkContext.defaultParallelism
    folded = {name: materialise(fold_assignment(d, "sku_key", p.n_folds, p.fold_seed).coalesce(2 * cores)) for name, d in frames.items()}
    names = list(frames)
    together = reduce(DataFrame.unionByName, [d.withColumn("dataset", F.lit(i)).select("dataset", "fold", "label", *cols) for i, d in enumerate(folded.values())])
    if kind == "LR":
        return logistic.held_out_accuracy(together, logistic.fit_folds(together, names, cols, p.n_folds))
    if kind == "GBT":
        ordered = [c for c in categories if c in cols]
        sums = orders = None
        found: dict[tuple[int, int], list[int]] = {}
        if ordered:
            sums = materialise(category_sums(together, ordered, by=["dataset", "fold"]))
            orders = materialise(category_order(training_sums(sums, p.n_folds), by=["dataset", "fold"]))
            for r in orders.groupBy("dataset", "fold", "column_name").count().collect():  # a row per data set, fold and column
                found.setdefault((r["dataset"], r["fold"]), []).append(r["count"])
        bins = [tree_bins(found.get((i, k), [])) for i in range(len(names)) for k in range(p.n_folds)]
        return boosting.held_out_accuracy(folded, cols, p, bins, ordered=ordered, sums=sums, orders=orders)

    def one(task: tuple[str, int]) -> float:
        name, k = task
        f = folded[name]
        m = fit(kind, f.filter(F.col("fold") != k), cols, p)
        r = predict(m, f.filter(F.col("fold") == k)).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).first()
        return float(r["a"])

    # The pool size is bounded by frames x folds, not by the data.
    tasks = [(name, k) for name in frames for k in range(p.n_folds)]
    with ThreadPoolExecutor(max_workers=max(1, parallelism or len(tasks))) as pool:
        scores = dict(zip(tasks, pool.map(one, tasks), strict=True))
    return {name: [scores[(name, k)] for k in range(p.n_folds)] for name in frames}


def fold_summary(scores: dict[str, list[float]]) -> DataFrame:
    """Mean, population deviation, smallest and largest fold score per data set."""
    rows = [(name, i, float(s)) for name, ss in scores.items() for i, s in enumerate(ss)]
    folds = SparkSession.getActiveSession().createDataFrame(rows, "dataset string, fold int, accuracy double")
    return summarise_folds(folds)


def summarise_folds(folds: DataFrame) -> DataFrame:
    return folds.groupBy("dataset").agg(
        F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"),
        F.min("accuracy").alias("min"), F.max("accuracy").alias("max"), F.count(F.lit(1)).alias("folds"),
    )
