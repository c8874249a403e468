"""Boosted trees of all folds fitted together, against Spark ML's single fits."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.operators.split import fold_assignment
from returnsight.plans import boosting as B
from returnsight.plans import models as MD
from returnsight.session import materialise

P = FIXTURE.with_(gbt_iters=6, n_folds=4, gbt_checkpoint_interval=3)
COLS = ["sku_size", "quantity", "receipted_rate", "ecom_rate"]


def frame(spark, n, seed):
    """Rows with missing values, a category of few rows, a column of few values and a constant one."""
    rng = np.random.default_rng(seed)
    x, c = rng.normal(size=n), rng.integers(0, 9, n) * rng.integers(0, 2, n)
    y = x + (c > 4) + rng.logistic(size=n) > 0.6
    rows = [(i, float(y[i]), None if i % 29 == 0 else float(c[i]), None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(x[i]), float(rng.integers(0, 5)), 3.0) for i in range(n)]
    return materialise(spark.createDataFrame(rows, "sku_key long, label double, sku_size double, quantity double, receipted_rate double, ecom_rate double").coalesce(1))


def single_fits(df, p):
    folded = materialise(fold_assignment(df, "sku_key", p.n_folds, p.fold_seed))
    scores = []
    for k in range(p.n_folds):
        m = MD.fit("GBT", folded.filter(F.col("fold") != k), COLS, p, categories=["sku_size"])
        scored = MD.predict(m, folded.filter(F.col("fold") == k))
        scores.append(scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0])
    return scores


def last_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.range(1).count()
    return max(tracker.getJobIdsForGroup(None))


def test_trees_of_all_folds_equal_single_fits_and_share_their_passes(spark):
    frames = {"a": frame(spark, 300, 1), "b": frame(spark, 90, 2)}
    before = last_job(spark)
    scores = MD.cv_scores("GBT", frames, COLS, P, categories=["sku_size"])
    jobs = last_job(spark) - before
    assert jobs < 120  # eight fits one by one take 18 jobs each for their levels alone
    for name, df in frames.items():
        assert scores[name] == pytest.approx(single_fits(df, P), abs=1e-12)


def test_partitions_blocks_and_checkpoints_change_nothing(spark, monkeypatch):
    df = frame(spark, 400, 3)
    whole = MD.cv_scores("GBT", {"x": df}, COLS, P, categories=["sku_size"])
    monkeypatch.setattr(B, "PARTITION_ROWS", 120)
    monkeypatch.setattr(B, "BLOCK_ROWS", 35)
    parts = MD.cv_scores("GBT", {"x": df}, COLS, P.with_(gbt_checkpoint_interval=-1), categories=["sku_size"])
    assert parts["x"] == pytest.approx(whole["x"], abs=0.03)  # sums in another order may turn a tie of gains


def test_no_checkpoint_is_left(spark):
    df = frame(spark, 60, 4)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    p = P.with_(gbt_iters=7)
    folded = {"x": materialise(fold_assignment(df, "sku_key", P.n_folds, P.fold_seed))}
    before = set(os.listdir(folder))
    B.held_out_accuracy(folded, COLS[1:], p, [32] * P.n_folds)
    assert set(os.listdir(folder)) == before


def test_many_rows_take_their_thresholds_from_a_draw(spark, monkeypatch):
    monkeypatch.setattr(B, "THRESHOLD_ROWS", 100)
    df = frame(spark, 2500, 5)  # more than 32 squared
    p = P.with_(n_folds=2, gbt_iters=5)
    got = MD.cv_scores("GBT", {"x": df}, COLS, p, categories=["sku_size"])["x"]
    assert got == pytest.approx(single_fits(df, p), abs=0.04)


def test_labels_of_one_class_and_wrong_labels(spark):
    df = frame(spark, 40, 6)
    p = P.with_(gbt_iters=2)
    assert MD.cv_scores("GBT", {"x": df.withColumn("label", F.lit(1.0))}, COLS, p)["x"] == [1.0] * 4
    with pytest.raises(ValueError, match="labels"):
        MD.cv_scores("GBT", {"x": df.withColumn("label", F.lit(2.0))}, COLS, p)


@pytest.mark.parametrize("most", [1, 5, 31])
def test_thresholds_follow_the_rule_value_by_value(most):
    rng = np.random.default_rng(most)
    for size, spread in ((200, 60), (500, 400), (1000, 3)):
        values = np.concatenate([rng.integers(0, spread, size), np.full(size // 2, 1)]).astype(float)
        v, n = np.unique(values, return_counts=True)
        want, target, seen = [], len(values) / (most + 1), n[0]
        if len(v) - 1 <= most:
            want = ((v[1:] + v[:-1]) / 2).tolist()
        else:
            for i in range(1, len(v)):
                last, seen = seen, seen + n[i]
                if abs(last - target) < abs(seen - target):
                    want.append((v[i - 1] + v[i]) / 2)
                    target += len(values) / (most + 1)
        assert B.thresholds_between(values, most).tolist() == want
