"""Distributed order statistics against numpy."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from returnsight.operators.quantiles import exact_quantiles
from returnsight.operators.ranking import dense_codes_long, range_index


def test_range_index_positions_and_running_sums(spark):
    vals = [5, 3, 9, 1, 7, 2, 8]
    df = spark.createDataFrame([(v, 1) for v in vals], "v long, one long").repartition(3)
    out = range_index(df, [F.col("v").asc()], sums=["v"], num_partitions=4).orderBy("_pos").collect()
    assert [r["v"] for r in out] == sorted(vals)
    assert [r["_pos"] for r in out] == list(range(len(vals)))
    assert [r["_cum_v"] for r in out] == list(np.cumsum(sorted(vals)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    probs = [0.25, 0.5, 0.75]
    mid = exact_quantiles(df, ["x"], probs, interpolation="midpoint")["x"]
    lin = exact_quantiles(df, ["x"], probs, interpolation="linear")["x"]
    assert np.allclose(mid, np.percentile(xs, [25, 50, 75], method="midpoint"), rtol=1e-12, atol=1e-9)
    assert np.allclose(lin, np.percentile(xs, [25, 50, 75], method="linear"), rtol=1e-12, atol=1e-9)


def test_quantiles_midpoint_differs_from_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.25], interpolation="midpoint")["x"] == [1.5]
    assert exact_quantiles(df, ["x"], [0.25], interpolation="linear")["x"] == [1.75]


def test_quantiles_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (float("nan"), 3.0), (4.0, 4.0)], "a double, b double")
    omit = exact_quantiles(df, ["a", "b"], [0.5])
    assert omit == {"a": [2.5], "b": [2.5]}
    prop = exact_quantiles(df, ["a", "b"], [0.5], nan_policy="propagate")
    assert prop == {"a": [None], "b": [2.5]}


def test_one_row_quartiles(spark):
    df = spark.createDataFrame([(3.0,)], "x double")
    assert exact_quantiles(df, ["x"], [0.25, 0.75], interpolation="midpoint")["x"] == [3.0, 3.0]


def test_dense_codes_sorted_empty_first_null_last(spark):
    df = spark.createDataFrame([("b",), ("",), ("a",), (None,), ("b",)], "c string")
    codes = {r["category"]: r["code"] for r in dense_codes_long(df, ["c"]).collect()}
    assert codes == {"": 0, "a": 1, "b": 2, None: 3}


def test_quantiles_with_a_value_held_by_a_third_of_rows(spark):
    rng = np.random.default_rng(3)
    xs = [0.0] * 300 + list(rng.normal(size=600))
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(5)
    got = exact_quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.75], interpolation="midpoint")["x"]
    assert np.allclose(got, np.percentile(xs, [10, 25, 50, 75], method="midpoint"), atol=1e-12)


def test_quantiles_of_several_columns_across_many_ranges(spark):
    rng = np.random.default_rng(11)
    n = 2000
    a = rng.normal(size=n)
    b = np.where(rng.random(n) < 0.1, np.nan, rng.exponential(size=n))
    c = np.round(rng.normal(size=n), 1)  # many ties
    df = spark.createDataFrame([(float(x), float(y), float(z)) for x, y, z in zip(a, b, c)], "a double, b double, c double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for method in ("linear", "midpoint"):
        got = exact_quantiles(df, ["c", "a", "b"], probs, interpolation=method)
        for name, xs in (("a", a), ("b", b), ("c", c)):
            want = np.nanpercentile(xs, [100 * p for p in probs], method=method)
            assert np.allclose(got[name], want, rtol=0, atol=1e-12), (method, name)
    prop = exact_quantiles(df, ["a", "b"], [0.5], nan_policy="propagate")
    assert prop["b"] == [None] and np.isclose(prop["a"][0], np.median(a))
