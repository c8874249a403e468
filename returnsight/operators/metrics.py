"""Classification metrics as aggregations over (label, prediction[, score]) frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnsight.operators.ranking import range_index


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )


def balanced_accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(TPR + TNR) / 2, which is what ROC AUC on hard 0/1 predictions equals."""
    y, p = F.col(label), F.col(prediction)
    tpr = F.try_divide(F.sum(((y == 1) & (p == 1)).cast("double")), F.sum((y == 1).cast("double")))
    tnr = F.try_divide(F.sum(((y == 0) & (p == 0)).cast("double")), F.sum((y == 0).cast("double")))
    return df.agg(((tpr + tnr) / 2).alias("balanced_accuracy"))


def score_table(rows: DataFrame, auc: float | None) -> DataFrame:
    """``(metric, value)``: accuracy on train, test and all rows and balanced accuracy of the test
    rows, from one aggregation over rows with ``is_test``, then the given ROC AUC."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    test, y = F.col("is_test"), F.col("label")
    one = rows.agg(
        F.avg(F.when(~test, hit)).alias("accuracy_train"), F.avg(F.when(test, hit)).alias("accuracy_test"), F.avg(hit).alias("accuracy_all"),
        ((F.avg(F.when(test & (y == 1), hit)) + F.avg(F.when(test & (y == 0), hit))) / 2).alias("balanced_accuracy"),
    ).withColumn("roc_auc", F.lit(auc).cast("double"))
    return one.unpivot([], one.columns, "metric", "value")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows = true label, columns = predicted 0 / 1."""
    return (
        df.groupBy(F.col(label).alias("label"))
        .pivot(prediction, [0, 1])
        .agg(F.count(F.lit(1)))
        .select("label", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"), F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1"))
    )


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and weighted averages.
    Undefined ratios are 0 (scikit-learn's zero_division default, with its warning dropped)."""
    y, p = F.col(label), F.col(prediction)
    c = df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    def f1(pr, rc):
        return F.coalesce(F.try_divide(2 * pr * rc, pr + rc), F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    m = c.select(
        ratio(tp, tp + fp).alias("p1"), ratio(tp, tp + fn).alias("r1"),
        ratio(tn, tn + fn).alias("p0"), ratio(tn, tn + fp).alias("r0"),
        (tp + fn).alias("s1"), (tn + fp).alias("s0"), (tp + fp + fn + tn).alias("n"),
        ratio(tp + tn, tp + fp + fn + tn).alias("acc"),
    ).select("*", f1(F.col("p1"), F.col("r1")).alias("f1_1"), f1(F.col("p0"), F.col("r0")).alias("f1_0"))
    w0, w1 = ratio(F.col("s0"), F.col("n")), ratio(F.col("s1"), F.col("n"))
    def row(name, precision, recall, f1_, support):
        return F.struct(
            F.lit(name).alias("class_name"), precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"), f1_.cast("double").alias("f1"), support.cast("long").alias("support"),
        )

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", F.col("p0"), F.col("r0"), F.col("f1_0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1_1"), F.col("s1")),
        row("accuracy", none, none, F.col("acc"), F.col("n")),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2, (F.col("f1_0") + F.col("f1_1")) / 2, F.col("n")),
        row(
            "weighted avg",
            w0 * F.col("p0") + w1 * F.col("p1"),
            w0 * F.col("r0") + w1 * F.col("r1"),
            w0 * F.col("f1_0") + w1 * F.col("f1_1"),
            F.col("n"),
        ),
    )
    return m.select(F.inline(rows)).select("class_name", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))


def _counted_scores(df: DataFrame, label: str, score: str, following: bool = False) -> DataFrame:
    """One row per distinct score, falling, with its positives and negatives, their running sums and
    totals, and on request those of the next score. Rows are reduced first (partial aggregation absorbs
    a score shared by a third of them); the running sums come from ``range_index``'s per-partition
    offsets, not a single-partition window."""
    per_score = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("tp"), F.count_if(F.col(label) != 1).alias("fp")
    )
    return range_index(
        per_score, [F.col("threshold").desc_nulls_last()], sums=["tp", "fp"], following=["tp", "fp"] if following else []
    )


def roc_points(df: DataFrame, label: str = "label", score: str = "score", *, drop_intermediate: bool = False) -> DataFrame:
    """ROC curve: one point per distinct score (descending) plus the origin.

    ``drop_intermediate`` leaves out the points on a straight run: those whose step from the point
    before equals the step to the point after (the first and the last score always stay), so that the
    curve keeps its shape and its corners."""
    idx = _counted_scores(df, label, score, following=drop_intermediate)
    if drop_intermediate:
        bends = (F.col("tp") != F.col("_next_tp")) | (F.col("fp") != F.col("_next_fp"))
        idx = idx.filter((F.col("_pos") == 0) | F.col("_next_tp").isNull() | bends)
    pts = idx.select(
        F.col("threshold").cast("double").alias("threshold"),
        F.try_divide(F.col("_cum_fp").cast("double"), F.col("_tot_fp").cast("double")).alias("fpr"),
        F.try_divide(F.col("_cum_tp").cast("double"), F.col("_tot_tp").cast("double")).alias("tpr"),
    )
    # The origin has no threshold (NULL): it stands for "predict nothing positive".
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ``(roc_auc, n_pos, n_neg)``: the share of (positive, negative) pairs
    in which the positive has the higher score, ties counting half; NULL without one of the classes.

    Twice the number of won pairs is summed exactly, as a decimal of 38 digits: each score's positives
    win against all negatives of lower scores and half of its own. Missing scores rank lowest, as one
    tie."""
    idx = _counted_scores(df, label, score)
    whole = {c: F.col(c).cast("decimal(19,0)") for c in ("tp", "fp", "_cum_fp", "_tot_fp")}
    won = whole["tp"] * (2 * (whole["_tot_fp"] - whole["_cum_fp"]) + whole["fp"])
    total = idx.agg(
        F.sum(won.cast("decimal(38,0)")).alias("won"), F.coalesce(F.max("_tot_tp"), F.lit(0)).alias("n_pos"), F.coalesce(F.max("_tot_fp"), F.lit(0)).alias("n_neg")
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return total.select(F.try_divide(F.col("won").cast("double"), 2 * pairs).alias("roc_auc"), "n_pos", "n_neg")
