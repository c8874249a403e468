"""Exact quantiles by refinement against numpy, and what a pass costs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnsight.operators import quantiles as Q

SCHEMA = "a double, b double, c double, d double"


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -1e-300, -5e-324, 0.0, 5e-324, 1e-9, 1.0, np.nextafter(1.0, 2), 1e300, np.inf])
    keys = Q.ordered_keys(x)
    assert (np.diff(keys) > 0).all()
    assert [Q.value_of(int(k)) for k in keys] == x.tolist()
    assert Q.ordered_keys(np.array([-0.0]))[0] == Q.ordered_keys(np.array([0.0]))[0]


@pytest.mark.parametrize("bits", [13, 3])
def test_quantiles_of_awkward_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(Q, "BITS", bits)
    rng = np.random.default_rng(4)
    n = 1200
    a = rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n)  # all magnitudes
    b = np.where(np.arange(n) < n // 3, 7.25, np.round(rng.normal(size=n), 3))  # one value in a third of the rows
    c = np.where(rng.random(n) < 0.1, np.nan, rng.normal(size=n))
    d = np.array([-np.inf] * 100 + [np.inf] * 400 + [0.0, -0.0] * 350)
    rows = [(float(a[i]), float(b[i]), None if np.isnan(c[i]) and i % 2 else float(c[i]), float(d[i])) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(df, ["d", "a", "c", "b"], probs)
    for name, x in (("a", a), ("b", b), ("c", c[~np.isnan(c)])):
        assert got[name] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    assert got["d"] == [-np.inf, 0.0, 0.0, 0.0, np.inf, np.inf, np.inf]
    mid = Q.exact_quantiles(df, ["a", "c"], probs, interpolation="midpoint", nan_policy="propagate")
    assert mid["a"] == pytest.approx(np.quantile(a, probs, method="midpoint").tolist(), rel=1e-12)
    assert mid["c"] == [None] * len(probs)


def test_columns_without_values_and_empty_frames(spark):
    df = spark.createDataFrame([(1.0, None, float("nan"), 2.0), (3.0, None, None, 2.0)], SCHEMA)
    assert Q.exact_quantiles(df, list("abcd"), [0.5]) == {"a": [2.0], "b": [None], "c": [None], "d": [2.0]}
    assert Q.exact_quantiles(df.limit(0), ["a"], [0.25, 0.5]) == {"a": [None, None]}


def test_all_columns_share_a_bounded_number_of_passes(spark, monkeypatch):
    passes = []
    counts = Q._counts
    monkeypatch.setattr(Q, "_counts", lambda *a, **k: passes.append(1) or counts(*a, **k))
    df = spark.range(50_000).select((F.col("id") * 0.37 + 1e5).alias("a"), F.sin("id").alias("b"), (F.col("id") % 3).cast("double").alias("c"), F.lit(1.0).alias("d"))
    Q.exact_quantiles(df, list("abcd"), [0.25, 0.5, 0.75])
    assert len(passes) <= -(-64 // Q.BITS)
    passes.clear()
    Q.exact_quantiles(df, ["c", "d"], [0.25, 0.5, 0.75])  # few values: each alone in its range at once
    assert len(passes) == 1


def test_a_pass_does_not_shuffle_rows(spark):
    df = spark.createDataFrame([(float(i), 0.0, 0.0, 0.0) for i in range(100)], SCHEMA).repartition(3)
    values = df.select(F.col("a").alias("c0"))
    counted = values.mapInArrow(Q._counter([Q._Range(0)], 1, True), Q._COUNTED).groupBy("range", "digit").agg(F.sum("n"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and plan.count("hashpartitioning(range") == 1
