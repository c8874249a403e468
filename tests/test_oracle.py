"""Every registered query with a SQL twin agrees with DuckDB on sf0.001 (row count, column
names and types, order-insensitive values)."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF001
from tools.check_oracle import SPARK_TO_DUCK, TABLES, value_hash

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert len(srows) == len(orows)
    assert sorted(df.columns) == sorted(rel.columns)
    st = {c: SPARK_TO_DUCK.get(t, t) for c, t in df.dtypes}
    ot = dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert st == ot
    assert value_hash(srows, df.columns) == value_hash(orows, rel.columns)


def test_every_query_has_an_oracle_or_is_a_model_query():
    # the training-data queries are held against brute force in their own tests
    model_like = {n for n in E.queries() if n not in E.oracle_sql() and not re.match(r"op\d+_|pipeline$", n)}
    assert all(any(t in n for t in ("predictions", "prediction_", "cv", "importance", "gbt_", "rf_", "lr_", "shap")) for n in model_like)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 116


@pytest.mark.parametrize("kind", ["gbt", "rf", "lr"])
def test_every_model_is_evaluated_the_same_way(spark, kind):
    qs = E.queries()
    head = qs["prediction_head" if kind == "gbt" else f"{kind}_prediction_head"](spark, SF001).collect()
    keys = [r["sku_key"] for r in head]
    assert keys == sorted(keys) and 0 < len(keys) <= 50
    n_test = qs[f"{kind}_predictions"](spark, SF001).count()
    conf = qs[f"{kind}_confusion"](spark, SF001).collect()
    assert sum(r["pred_0"] + r["pred_1"] for r in conf) == n_test
    report = {r["class_name"]: r for r in qs[f"{kind}_class_report"](spark, SF001).collect()}
    assert report["accuracy"]["support"] == n_test
    metrics = {r["metric"]: r["value"] for r in qs[f"{kind}_scores"](spark, SF001).collect()}
    assert set(metrics) == {"accuracy_train", "accuracy_test", "accuracy_all", "balanced_accuracy", "roc_auc"}
    assert all(0.0 <= v <= 1.0 for v in metrics.values())
    assert abs(metrics["accuracy_test"] - report["accuracy"]["f1"]) < 1e-12
    roc = qs[f"{kind}_roc"](spark, SF001).collect()
    pts = sorted((r["fpr"], r["tpr"]) for r in roc)
    assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
