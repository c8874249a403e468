"""Shapley values: brute force on a tiny tree, local accuracy on fitted models, linear closed form."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnsight.plans import explain as EX
from returnsight.plans.explain import LeafPath, TreeTables


def _tiny() -> TreeTables:
    # x0 <= 0.5 (cover 6 of 10) ? (x1 <= 1 (4 of 6) ? 1.0 : 2.0) : 5.0
    leaves = [
        LeafPath(1.0, [(0, 0.5, True, 0.6), (1, 1.0, True, 4 / 6)]),
        LeafPath(2.0, [(0, 0.5, True, 0.6), (1, 1.0, False, 2 / 6)]),
        LeafPath(5.0, [(0, 0.5, False, 0.4)]),
    ]
    return TreeTables([1.0], [leaves], 1.0, 3)


def _expect(x, s, tables):
    """Recursive path-dependent expectation, written independently of the vectorised code."""
    total = 0.0
    for leaf in tables.leaves[0]:
        w = 1.0
        for f, thr, left, share in leaf.steps:
            if f in s:
                w *= 1.0 if ((x[f] <= thr) == left) else 0.0
            else:
                w *= share
        total += w * leaf.value
    return total


def _shapley(m, v):
    """Values of the game ``v`` (a function of sets of players) by its definition."""
    out = []
    for i in range(m):
        others, total = [j for j in range(m) if j != i], 0.0
        for k in range(m):
            for s in itertools.combinations(others, k):
                total += math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (v(set(s) | {i}) - v(set(s)))
        out.append(total)
    return out


def _random_tables(rng, m, trees=4, depth=4):
    """Trees whose paths meet features again, with shares that need not be the covers of any data."""

    def grow(steps, left):
        if not left or rng.random() < 0.15:
            return [LeafPath(float(rng.normal()), steps)]
        f, threshold, share = int(rng.integers(0, m)), float(rng.normal()), float(rng.choice([0.0, 0.3, 0.6, 1.0]))
        return grow([*steps, (f, threshold, True, share)], left - 1) + grow([*steps, (f, threshold, False, 1 - share)], left - 1)

    return TreeTables([1.0, 0.5, 0.25, 2.0][:trees], [grow([], depth) for _ in range(trees)], 2.0, m)


def _output(x, tables):
    total = 0.0
    for w, leaves in zip(tables.weights, tables.leaves, strict=True):
        for leaf in leaves:
            if all((x[f] <= t) == left for f, t, left, _ in leaf.steps):
                total += w * leaf.value
    return total * tables.scale


def _expected(x, s, tables):
    total = 0.0
    for w, leaves in zip(tables.weights, tables.leaves, strict=True):
        total += w * _expect(x, s, TreeTables([1.0], [leaves], 1.0, tables.n_features))
    return total * tables.scale


def test_path_values_equal_the_definition():
    rng = np.random.default_rng(12)
    for tables in (_tiny(), _random_tables(rng, 5), _random_tables(rng, 3, depth=6), TreeTables([1.0], [[LeafPath(3.0, [])]], 1.0, 2)):
        m, x = tables.n_features, rng.normal(size=(6, tables.n_features))
        paths = EX.paths_of(tables)
        phi = EX.path_values(x, paths, m)
        for r in range(len(x)):
            assert phi[r].tolist() == pytest.approx(_shapley(m, lambda s, r=r: _expected(x[r], s, tables)), abs=1e-9)
        assert EX.base_value(paths) == pytest.approx(_expected(x[0], set(), tables))


def test_missing_values_take_every_right_turn():
    x = np.array([[np.nan, 0.5, 0.0]])
    path = EX.paths_of(_tiny())
    assert [p.follows(x).all() for p in path] == [False, False, True]


def _framed(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "sku_key long, " + ", ".join(f"{n} double" for n in names)), names


def test_background_values_equal_the_definition(spark):
    rng = np.random.default_rng(13)
    tables = _random_tables(rng, 4)
    x, z = rng.normal(size=(5, 4)), rng.normal(size=(40, 4))
    z[:15] = z[0]  # rows that meet the same conditions
    df, names = _framed(spark, x)
    long, base = EX.tables_background_shap(df, tables, names, _framed(spark, z)[0].repartition(3))
    got = {(r["sku_key"], r["feature"]): r["phi"] for r in long.collect()}
    assert base == pytest.approx(np.mean([_output(row, tables) for row in z]))
    for r in range(5):
        want = _shapley(4, lambda s, r=r: np.mean([_output([x[r][j] if j in s else row[j] for j in range(4)], tables) for row in z]))
        assert [got[r, n] for n in names] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError, match="no rows"):
        EX.tables_background_shap(df, tables, names, df.limit(0))


def test_background_values_of_a_fitted_model(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import models as MD

    df = _planted(spark, 60)
    m = MD.fit("GBT", df, ["a", "b", "c"], FIXTURE.with_(gbt_iters=6))
    some = df.filter("sku_key < 3")
    long, base = EX.background_shap(some, m, df)
    got = {(r["sku_key"], r["feature"]): r["phi"] for r in long.collect()}
    z = np.array([[r["a"], r["b"], r["c"]] for r in df.collect()])
    mixed = []  # every coalition's rows, through the model itself
    for r in some.collect():
        for s in itertools.product([0, 1], repeat=3):
            mixed += [(int(r["sku_key"] * 8 + s[0] + 2 * s[1] + 4 * s[2]), 0.0, *(float(r[c]) if on else float(v) for c, on, v in zip("abc", s, row, strict=True))) for row in z]
    out = MD.predict(m, spark.createDataFrame(mixed, df.schema)).groupBy("sku_key").agg(F.avg(F.log(F.col("probability") / (1 - F.col("probability")))).alias("v"))
    v = {r["sku_key"]: r["v"] for r in out.collect()}
    assert base == pytest.approx(v[0], abs=1e-9)
    for r in range(3):
        want = _shapley(3, lambda s, r=r: v[r * 8 + sum(2**j for j in s)])
        assert [got[r, c] for c in "abc"] == pytest.approx(want, abs=1e-9)


def _planted(spark, n=400):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.1 * rng.normal(size=n) > 0).astype(float)
    return spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], "sku_key long, label double, a double, b double, c double")


def test_tree_models_local_accuracy_and_signal(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import models as MD

    df = _planted(spark)
    cols = ["a", "b", "c"]
    p = FIXTURE.with_(gbt_iters=15, rf_trees=20)
    for kind in ("GBT", "RF"):
        m = MD.fit(kind, df, cols, p)
        long, base = EX.tree_shap(df, m)
        pred = MD.predict(m, df)
        acc = pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert acc > 0.8  # better than the ~50 % majority class on planted signal
        out = F.log(F.col("probability") / (1 - F.col("probability"))) if kind == "GBT" else F.col("probability")
        err = (
            long.groupBy("sku_key").agg(F.sum("phi").alias("s"))
            .join(pred.select("sku_key", out.alias("f")), "sku_key")
            .agg(F.max(F.abs(F.col("s") + F.lit(base) - F.col("f")))).first()[0]
        )
        assert err < 1e-6
        imp = {r["feature"]: r["mean_abs_phi"] for r in EX.global_importance(long).collect()}
        assert imp["a"] > imp["c"]


def test_linear_closed_form(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import models as MD

    df = _planted(spark)
    cols = ["a", "b", "c"]
    m = MD.fit("LR", df, cols, FIXTURE)
    long, base = EX.linear_shap(df, m, df)
    pred = MD.predict(m, df)
    err = (
        long.groupBy("sku_key").agg(F.sum("phi").alias("s"))
        .join(pred.select("sku_key", F.log(F.col("probability") / (1 - F.col("probability"))).alias("f")), "sku_key")
        .agg(F.max(F.abs(F.col("s") + F.lit(base) - F.col("f")))).first()[0]
    )
    assert err < 1e-6  # log-odds recovered from probabilities near 0 or 1 lose digits
    # mean phi of each feature over the background is zero
    means = long.groupBy("feature").agg(F.avg("phi").alias("m")).collect()
    assert all(abs(r["m"]) < 1e-9 for r in means)


def test_one_row_running_total(spark):
    long = spark.createDataFrame([(1, "a", 0.0, 0.5), (1, "b", 0.0, -2.0), (1, "c", 0.0, 1.0), (2, "a", 0.0, 9.0)],
                                 "sku_key long, feature string, value double, phi double")
    rows = EX.one_row(long.filter("sku_key = 1"), 1.0).orderBy("rank").collect()
    assert [r["feature"] for r in rows] == ["b", "c", "a"]
    assert [r["cumulative"] for r in rows] == [-1.0, 0.0, 0.5]


def test_picked_rows_are_filtered_before_they_are_explained(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import models as MD

    df = _planted(spark, 60)
    m = MD.fit("RF", df, ["a", "b", "c"], FIXTURE.with_(rf_trees=3))
    long, base = EX.tree_shap(EX.picked_rows(df), m)
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInPandas") < plan.index("Filter") or "MapInPandas" in plan.split("Filter")[0]
    assert {r["sku_key"] for r in EX.one_row(long, base).collect()} == {0, 8, 10}


def test_boosted_trees_with_categories_unseen_codes_and_missing_values(spark):
    from returnsight.config import FIXTURE
    from returnsight.plans import models as MD

    rng = np.random.default_rng(3)
    n, k = 500, 9
    cat = rng.integers(0, k - 2, n)  # the two last codes of the dictionary do not occur in training
    x = rng.normal(size=n)
    y = ((cat % 3 == 0) ^ (x > 0.3)).astype(float)
    rows = [(i, float(y[i]), float(cat[i]), None if i % 17 == 0 else float(x[i])) for i in range(n)]
    schema = "sku_key long, label double, sku_size double, quantity double"
    m = MD.fit("GBT", spark.createDataFrame(rows, schema), ["sku_size", "quantity"], FIXTURE.with_(gbt_iters=20), categories=["sku_size", "sku_color"])
    assert m.order.categories == {"sku_size": k - 2} and m.fill["quantity"] < min(v for *_, v in rows if v is not None)
    known = spark.createDataFrame([(i, 0.0, float(c), v) for i, (c, v) in enumerate(itertools.product(range(k + 3), (-1.0, 0.31, 2.0, None)))], schema)
    long, base = EX.tree_shap(known, m)
    want = MD.predict(m, known).select("sku_key", F.log(F.col("probability") / (1 - F.col("probability"))).alias("f"))
    off = long.groupBy("sku_key").agg(F.sum("phi").alias("s")).join(want, "sku_key").agg(F.max(F.abs(F.col("s") + F.lit(base) - F.col("f")))).first()[0]
    assert off < 1e-9
    assert long.filter("value IS NULL").count() == k + 3
    shown = {r["sku_key"]: r["value"] for r in long.filter("feature = 'sku_size'").collect()}
    assert shown == {i: float(i // 4) for i in range(4 * (k + 3))}  # the codes, not their places
    same = long.filter(f"feature = 'sku_size' AND value >= {k - 2}").groupBy("sku_key").agg(F.sum("phi").alias("s"))
    by_quantity = {}
    for r in same.collect():
        by_quantity.setdefault(r["sku_key"] % 4, set()).add(round(r["s"], 9))
    assert all(len(v) == 1 for v in by_quantity.values())  # unseen codes stand in one place
