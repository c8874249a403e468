"""Preparation quirks: label at the median, IQR rules, logs, imputation, z-scores, text flags."""

import math


from returnsight.config import FIXTURE, Params
from returnsight.operators import prepare as P


def test_label_strictly_above_median_missing_is_zero(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, None)], "sku_key long, return_rate double")
    got = {r["sku_key"]: r["label"] for r in P.return_label(df).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0}


def test_label_encode_replaces_with_sorted_codes(spark):
    df = spark.createDataFrame([(1, "M", "red"), (2, "", "blue"), (3, "L", "red")], "sku_key long, sku_size string, sku_color string")
    got = {r["sku_key"]: (r["sku_size"], r["sku_color"]) for r in P.label_encode(df).collect()}
    assert got == {1: (2, 1), 2: (0, 0), 3: (1, 1)}


def test_log_of_nonpositive_is_null(spark):
    df = spark.createDataFrame([(1, 0.0), (2, -1.0), (3, math.e)], "sku_key long, quantity double")
    got = {r["sku_key"]: r["quantity"] for r in P.log_columns(df, ["quantity"]).collect()}
    assert got[1] is None and got[2] is None and abs(got[3] - 1.0) < 1e-12


def test_brand_pattern_needs_the_leading_space(spark):
    p = Params()  # reference patterns
    df = spark.createDataFrame(
        [(1, "Adidas shoes"), (2, "Mens ADIDAS"), (3, "nike socks"), (4, None), (5, "Golf Shoes")],
        "sku_key long, product_desc string",
    )
    got = {r["sku_key"]: (r["footwear"], r["brand"]) for r in P.text_flags(df, p).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (0, 0), 5: (1, 0)}


def _frame(spark, xs):
    return spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "sku_key long, ecom_rate double")


def test_iqr_drops_both_tails_inclusive(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    # midpoint quartiles: Q1 = 3, Q3 = 7, IQR = 4; bounds 1 and 9 with factor 0.5, both inclusive
    kept = sorted(r["ecom_rate"] for r in P.iqr_filter(_frame(spark, xs), ["ecom_rate"], 0.5).collect())
    assert kept == [2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]


def test_iqr_missing_value_propagates_and_drops_nothing(spark):
    xs = [1.0, 2.0, 3.0, 100.0, None]
    assert P.iqr_filter(_frame(spark, xs), ["ecom_rate"], 0.5).count() == 5
    assert P.iqr_filter(_frame(spark, xs), ["ecom_rate"], 0.5, nan_policy="omit").count() < 5


def test_iqr_zero_drops_upper_set_only(spark):
    xs = [0.5, 0.5, 0.5, 0.5, 0.1, 0.9]
    kept = sorted(r["ecom_rate"] for r in P.iqr_filter(_frame(spark, xs), ["ecom_rate"], 0.5).collect())
    assert kept == [0.1]  # rows >= 0.5 go; the failing second drop keeps the lower rows
    both = sorted(r["ecom_rate"] for r in P.iqr_filter(_frame(spark, xs), ["ecom_rate"], 0.5, overlap="both").collect())
    assert both == []


def test_impute_mean_fills_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, 3.0)], "sku_key long, receipted_rate double")
    got = {r["sku_key"]: r["receipted_rate"] for r in P.impute_mean(df, ["receipted_rate"]).collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 2.0, 4: 3.0}


def test_zscore_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 5.0)], "sku_key long, a double, b double")
    got = {r["sku_key"]: (r["z_a"], r["z_b"]) for r in P.zscores(df, ["a", "b"]).collect()}
    sd = math.sqrt(2 / 3)
    assert abs(got[1][0] - 1 / sd) < 1e-12 and got[2][0] == 0.0
    assert all(v[1] is None for v in got.values())


def test_fixture_median_matches_documented_value(spark):
    from returnsight.operators.quantiles import exact_median
    from returnsight.plans.pipeline import feature_table
    from tests.conftest import SF001

    med = exact_median(feature_table(spark, SF001, FIXTURE), "return_rate")
    assert abs(med - 0.2667) < 1e-4


def test_predictor_variants(spark):
    from returnsight.config import predictors

    assert predictors("All") == ["receipted_rate", "sku_color", "sku_size", "avg_price_product", "quantity", "ecom_rate"]
    assert predictors("Footwear")[-1] == "footwear" and predictors("Brand")[-1] == "brand"
    import pytest

    with pytest.raises(ValueError):
        predictors("Shoes")
