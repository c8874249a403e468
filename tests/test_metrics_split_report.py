"""Metrics, splitting and report operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnsight.operators import metrics as M
from returnsight.operators import report as R
from returnsight.operators.ranking import range_index
from returnsight.operators.split import fold_assignment, holdout_split

PAIRS = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (0, 0), (1, 1)]


def _df(spark):
    return spark.createDataFrame([(i, y, p, s) for i, ((y, p), s) in enumerate(zip(PAIRS, [0.9, 0.8, 0.3, 0.2, 0.1, 0.7, 0.4, 0.6]))],
                                 "sku_key long, label int, prediction int, score double")


def test_confusion_sums_to_n(spark):
    c = {r["label"]: (r["pred_0"], r["pred_1"]) for r in M.confusion(_df(spark)).collect()}
    assert c == {0: (3, 1), 1: (1, 3)} and sum(a + b for a, b in c.values()) == len(PAIRS)


def test_class_report_and_balanced_accuracy(spark):
    rep = {r["class_name"]: r for r in M.class_report(_df(spark)).collect()}
    assert rep["1"]["precision"] == 0.75 and rep["1"]["recall"] == 0.75 and rep["0"]["support"] == 4
    assert rep["accuracy"]["f1"] == 0.75 and rep["accuracy"]["precision"] is None
    assert M.balanced_accuracy(_df(spark)).first()[0] == 0.75
    assert M.accuracy(_df(spark)).first()["accuracy"] == 0.75


def test_class_report_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    rep = {r["class_name"]: r for r in M.class_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["f1"] == 0.0


def test_roc_monotone_from_origin_to_one(spark):
    pts = M.roc_points(_df(spark)).collect()
    pts = sorted(((r["fpr"], r["tpr"]) for r in pts))
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
    assert all(b[1] >= a[1] for a, b in zip(pts, pts[1:]))


def test_roc_with_tied_scores(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.1)], "label int, score double")
    pts = {r["threshold"]: (r["fpr"], r["tpr"]) for r in M.roc_points(df).collect()}
    assert pts[0.5] == (0.5, 1.0) and pts[0.1] == (1.0, 1.0) and pts[None] == (0.0, 0.0)


def _pairs_won(rows):
    pos, neg = [s for y, s in rows if y == 1], [s for y, s in rows if y != 1]
    key = lambda s: (s is not None, s or 0.0)  # noqa: E731  missing scores rank lowest
    won = sum((key(a) > key(b)) + 0.5 * (key(a) == key(b)) for a in pos for b in neg)
    return won / (len(pos) * len(neg))


def test_auc_equals_the_pairs_won(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.random() < 0.3 + 0.4 * s), float(s)) for s in rng.random(1500)]  # more than 1,000 different scores
    rows += [(int(rng.random() < 0.5), 0.5) for _ in range(700)]  # a tie of a third of the rows
    rows += [(int(rng.random() < 0.6), float(round(s, 1))) for s in rng.random(200)] + [(1, None), (0, None), (0, None)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(6)
    got = M.roc_auc(df).first()
    assert got["roc_auc"] == pytest.approx(_pairs_won(rows), abs=1e-14)
    assert (got["n_pos"], got["n_neg"]) == (sum(y for y, _ in rows), sum(1 - y for y, _ in rows))


def test_auc_of_one_class_and_of_no_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.2)], "label int, score double")
    assert tuple(M.roc_auc(df).first()) == (None, 2, 0)
    assert tuple(M.roc_auc(df.limit(0)).first()) == (None, 0, 0)


def _corners(rows):
    """Points whose second difference of either count is not zero, and the first and the last."""
    steps = {}
    for y, s in rows:
        tp, fp = steps.get(s, (0, 0))
        steps[s] = (tp + (y == 1), fp + (y != 1))
    scores = sorted(steps, reverse=True)
    return {s for i, s in enumerate(scores) if i in (0, len(scores) - 1) or steps[s] != steps[scores[i + 1]]}


def test_corners_of_the_curve_over_range_borders(spark):
    rng = np.random.default_rng(2)
    rows = [(1, 900.0 - i) for i in range(300)] + [(0, 500.0 - i) for i in range(300)]  # two straight runs
    rows += [(int(rng.random() < 0.5), float(rng.integers(0, 150))) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, score double").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight ranges, so runs cross their borders
    try:
        got = M.roc_points(df, drop_intermediate=True).collect()
        full = {(r["threshold"], r["fpr"], r["tpr"]) for r in M.roc_points(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {r["threshold"] for r in got} == _corners(rows) | {None}
    assert {(r["threshold"], r["fpr"], r["tpr"]) for r in got} <= full
    assert len(got) < 200


def test_range_index_hands_values_over_range_borders(spark):
    df = spark.range(100).select((F.col("id") * 37 % 100).alias("v"))
    out = range_index(df, [F.col("v").asc()], following=["v"], num_partitions=7).orderBy("_pos").collect()
    assert [r["_next_v"] for r in out] == [*range(1, 100), None] and {r["_rows"] for r in out} == {100}


def test_folds_disjoint_cover_and_stable_under_repartition(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "sku_key")
    a = {r["sku_key"]: r["fold"] for r in fold_assignment(df, n_folds=10, seed=1).collect()}
    b = {r["sku_key"]: r["fold"] for r in fold_assignment(df.repartition(7), n_folds=10, seed=1).collect()}
    assert a == b and set(a.values()) == set(range(10)) and len(a) == 500
    s = holdout_split(df, test_fraction=0.3, seed=10)
    assert s.filter("is_test").count() == 150


def test_split_sizes_are_exact(spark):
    import pytest

    for n in (10, 87, 113):
        df = spark.range(n).withColumnRenamed("id", "sku_key").repartition(3)
        assert holdout_split(df, test_fraction=0.3).filter("is_test").count() == -(-3 * n // 10)
        sizes = [r["count"] for r in fold_assignment(df, n_folds=10).groupBy("fold").count().collect()]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1
    with pytest.raises(ValueError, match="10 folds of 9 rows"):
        fold_assignment(spark.range(9).withColumnRenamed("id", "sku_key"), n_folds=10)


def test_key_hash_matches_documented_value(spark):
    import hashlib

    from returnsight.functions import key_hash

    assert spark.range(1).select(key_hash(F.lit(5), 10)).first()[0] == hashlib.md5(b"5|10").hexdigest()


def test_top_k_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("b", 0.5), ("a", 0.5), ("c", None), ("d", 0.9), ("e", 0.1), ("f", 0.2)],
        "product_desc string, avg_return_rate double",
    )
    top = [r["product_desc"] for r in R.top_k(df, 5).collect()]
    assert top == ["d", "a", "b", "f", "e"]


def test_report_brand_filter_case_insensitive(spark):
    df = spark.createDataFrame([("ADIDAS socks",), ("adidas",), ("Nike",), (None,)], "product_desc string")
    assert R.matching(df, "Adidas").count() == 2


def test_one_class_label(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.7), (0, 0, 0.1)], "label int, prediction int, score double")
    assert M.balanced_accuracy(df).first()[0] is None  # no positives: recall of class 1 undefined
    pts = M.roc_points(df).collect()
    assert all(r["tpr"] is None or r["threshold"] is None for r in pts)
    rep = {r["class_name"]: r for r in M.class_report(df).collect()}
    assert rep["1"]["support"] == 0 and rep["0"]["recall"] == 2 / 3


def test_products_that_differ_past_the_sixth_decimal_rank_by_their_rates(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import sql_build as S

    df = spark.createDataFrame([("a ring", 0.5000001), ("b ring", 0.5000002), ("c ring", 0.4)], "product_desc string, avg_return_rate double").withColumn("avg_ecom_rate", F.lit(0.1))
    assert [r["product_desc"] for r in R.top_k(df, 2).collect()] == ["b ring", "a ring"]
    df.createOrReplaceTempView("rank_report")
    assert [r["product_desc"] for r in S.top_products(spark, "rank_report", FIXTURE.family_pattern, 2).collect()] == ["b ring", "a ring"]
