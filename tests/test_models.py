"""Models on awkward frames: missing predictors, nominal columns, losses, constant columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.operators.explore import correlation
from returnsight.operators.ordering import category_order, category_sums, training_sums
from returnsight.plans import models as MD
from returnsight.plans.logistic import fit_folds, held_out_accuracy

P = FIXTURE.with_(gbt_iters=20, rf_trees=5)
SCHEMA = "sku_key long, label double, sku_size double, quantity double, ecom_rate double"


def frame(spark, n=300, nulls=(7,)):
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(n, 2)), rng.integers(0, 6, n)
    rows = [(i, float(x[i, 0] + (c[i] > 2) > 0.4), float(c[i]), None if i in nulls else float(x[i, 0]), float(x[i, 1])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


COLS = ["sku_size", "quantity", "ecom_rate"]


@pytest.mark.parametrize("kind", ["GBT", "RF", "LR"])
@pytest.mark.parametrize("nulls", [(7,), tuple(range(300))])
def test_missing_predictors_fit_and_score(spark, kind, nulls):
    df = frame(spark, nulls=nulls)
    m = MD.fit(kind, df, COLS, P, categories=["sku_size"] if kind == "GBT" else [])
    out = MD.predict(m, df)
    assert out.count() == 300 and out.filter("probability IS NULL OR isnan(probability)").count() == 0
    known = [r[0] for r in df.select("quantity").collect() if r[0] is not None]
    want = 0.0 if not known else min(known) - max(1.0, max(known) - min(known)) if kind == "GBT" else float(np.mean(known))
    assert m.fill["quantity"] == pytest.approx(want)


def test_more_categories_than_rows_fit(spark):
    df = frame(spark)
    m = MD.fit("GBT", df.filter("sku_key < 5"), COLS, P.with_(gbt_iters=2), categories=["sku_size", "sku_color"])
    assert set(m.order.places) == {"sku_size"} and all(r["ncat"] == -1 for r in MD.node_table(m))
    assert MD.predict(m, df).filter("probability IS NULL").count() == 0  # most codes have not been seen


def test_category_order_takes_smoothed_label_means(spark):
    rows = [(1.0, c) for c in [0] * 8 + [1] * 1 + [2] * 30] + [(0.0, c) for c in [0] * 2 + [1] * 1 + [3] * 40] + [(1.0, None), (0.0, None)]
    df = spark.createDataFrame(rows, "label double, sku_size int")
    got = {r["code"]: r for r in category_order(category_sums(df, ["sku_size"])).collect()}
    overall = sum(y for y, _ in rows) / len(rows)
    for code, r in got.items():
        own = [y for y, c in rows if c == code]
        assert r["n"] == len(own) and r["label_mean"] == pytest.approx((sum(own) + 10 * overall) / (len(own) + 10))
    order = sorted(got, key=lambda c: (got[c]["label_mean"], c is None, c or 0))
    assert [got[c]["place"] for c in order] == list(range(5))
    assert {r["unseen"] for r in got.values()} == {sum(r["label_mean"] < overall for r in got.values()) - 0.5}


def test_no_label_of_a_held_out_fold_is_in_its_order(spark):
    rng = np.random.default_rng(8)
    rows = [(0, i % 4, float(rng.random() < 0.5), float(rng.integers(0, 12))) for i in range(200)]
    schema = "dataset int, fold int, label double, sku_size double"

    def orders(changed):
        df = spark.createDataFrame(changed, schema)
        sums = training_sums(category_sums(df, ["sku_size"], by=["dataset", "fold"]), 4)
        return {(r["fold"], r["code"]): (r["n"], r["place"], r["label_mean"]) for r in category_order(sums, by=["dataset", "fold"]).collect()}

    before = orders(rows)
    after = orders([(d, k, 1 - y if k == 2 else y, c) for d, k, y, c in rows])
    assert {k: v for k, v in before.items() if k[0] == 2} == {k: v for k, v in after.items() if k[0] == 2}
    assert before != after
    for k in range(4):  # as learned from the training rows alone
        alone = category_order(category_sums(spark.createDataFrame([r for r in rows if r[1] != k], schema), ["sku_size"])).collect()
        assert {(k, r["code"]): (r["n"], r["place"], r["label_mean"]) for r in alone} == {key: v for key, v in before.items() if key[0] == k}


def _folded(spark, n=400):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 3, 1]
    y = (x @ [1.0, -0.4, 2.0] + rng.logistic(size=n) > 1).astype(float)
    rows = [(i % 2, int(k), float(y[i]), float(x[i, 0]), None if i % 13 == 0 else float(x[i, 1]), float("nan") if i % 17 == 0 else float(x[i, 2])) for i, k in enumerate(rng.integers(0, 10, n))]
    return spark.createDataFrame(rows, "dataset int, fold int, label double, a double, b double, c double").repartition(4)


def test_folds_fitted_together_equal_single_fits(spark):
    df, cols = _folded(spark), ["a", "b", "c"]
    models = fit_folds(df, ["x", "y"], cols, 10)
    assert models.passes <= 9
    for name, k in (("x", 0), ("x", 7), ("y", 3)):
        train = df.filter(f"dataset = {'xy'.index(name)} AND fold <> {k}")
        fill = MD.missing_values("LR", train, cols)
        single = MD.estimator("LR", P, train.count()).setTol(1e-13).setMaxIter(500).fit(MD.assemble(MD.fill_missing(train, fill), cols))
        m = models.number(name, k)
        assert models.means[m].tolist() == pytest.approx([fill[c] for c in cols])
        assert models.weights[m, 1:].tolist() == pytest.approx(single.coefficients.toArray().tolist(), abs=1e-6)
        assert models.weights[m, 0] == pytest.approx(single.intercept, abs=1e-6)
    scores = held_out_accuracy(df, models)
    assert set(scores) == {"x", "y"} and all(len(s) == 10 and min(s) > 0.4 for s in scores.values())


def test_folds_of_one_class_and_of_separable_rows(spark):
    cols = ["a"]
    rows = [(0, i % 5, 1.0, float(i)) for i in range(20)] + [(1, i % 5, float(i >= 10), float(i) * 1000) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset int, fold int, label double, a double")
    models = fit_folds(df, ["ones", "apart"], cols, 5)
    assert np.isposinf(models.weights[:5, 0]).all() and np.isfinite(models.weights[5:]).all()
    scores = held_out_accuracy(df, models)
    assert scores["ones"] == [1.0] * 5 and min(scores["apart"]) >= 0.75


def test_history_is_the_mean_log_loss(spark):
    df = frame(spark)
    m = MD.fit("GBT", df, COLS, P, categories=["sku_size"])
    history = MD.eval_history(m, df, df.filter("sku_key < 100")).collect()
    assert [r["iteration"] for r in history] == [10, 20]
    own = -F.log(F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability")))
    loss = MD.predict(m, df).agg(F.avg(own)).first()[0]
    assert history[-1]["train_loss"] == pytest.approx(loss, abs=1e-9)


def test_cross_validation_summary_has_no_gaps(spark):
    df = frame(spark, 40)
    scores = MD.cv_scores("LR", {"all": df}, COLS, P)
    row = MD.fold_summary(scores).first()
    assert row["folds"] == 10 and all(row[c] == row[c] for c in ("mean", "std", "min", "max"))
    with pytest.raises(ValueError, match="folds"):
        MD.cv_scores("LR", {"all": df.limit(9)}, COLS, P)


def test_correlation_of_constant_and_partly_missing_columns(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=50), rng.normal(size=50)
    rows = [(float(a[i]), None if i < 5 else float(b[i]), 3.0, 1.0 if i < 5 else 2.0, None) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in correlation(df, list("abcde")).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(a[5:], b[5:])[0, 1]) and got["a", "a"] == 1.0
    assert got["a", "c"] is None and got["c", "c"] is None and got["e", "e"] is None
    assert got["b", "d"] is None  # constant where both are present
