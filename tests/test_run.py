"""The end-to-end run and production-schema inputs."""

import os
import tempfile

from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.plans import pipeline as PL
from returnsight.plans.run import run
from returnsight.sources import Source, fixture_detail, fixture_sku, write_table
from tests.conftest import SF001


def test_production_tables_give_the_same_features(spark):
    base = tempfile.mkdtemp(prefix="returnsight-prod-")
    write_table(fixture_detail(spark, SF001), os.path.join(base, "std_clnt_detail"))
    write_table(fixture_sku(spark, SF001), os.path.join(base, "std_clnt_sku"))
    prod = Source(detail=os.path.join(base, "std_clnt_detail"), sku=os.path.join(base, "std_clnt_sku"))
    a = PL.feature_table(spark, prod, FIXTURE)
    b = PL.feature_table(spark, SF001, FIXTURE)
    key = ["sku_key", "product_desc"]
    ra = a.select(*key, F.round("avg_price_product", 9)).orderBy(*key).collect()
    rb = b.select(*key, F.round("avg_price_product", 9)).orderBy(*key).collect()
    assert ra == rb and len(ra) == 116


def test_run_writes_every_table(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="returnsight-run-"), "o")
    written = run(spark, SF001, FIXTURE, out, "LR", cross_validate=False)
    assert "cv_summary" not in written and "eval_history" not in written
    for name in ("features", "predictions", "shap_values", "top_family", "roc", "importance"):
        assert name in written and spark.read.parquet(os.path.join(out, name)).count() > 0
    # Shapley values sum to the model's log-odds minus the base value, for every row
    shap = spark.read.parquet(os.path.join(out, "shap_values"))
    assert shap.select("sku_key").distinct().count() == spark.read.parquet(os.path.join(out, "prepared")).count()


def test_variant_predictor_set_reaches_the_model(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="returnsight-run-"), "o")
    p = FIXTURE.with_(predictor_set="Brand", rf_trees=10)
    written = run(spark, SF001, p, out, "RF", cross_validate=False, only=["importance", "shap_global"])
    assert written == ["importance", "shap_global"]
    feats = {r["feature"] for r in spark.read.parquet(os.path.join(out, "importance")).collect()}
    assert "brand" in feats and len(feats) == 7


def test_write_table_overwrites_on_rerun(spark):
    target = os.path.join(tempfile.mkdtemp(prefix="returnsight-sink-"), "t")
    df = spark.range(5)
    write_table(df, target)
    write_table(df, target)
    assert spark.read.parquet(target).count() == 5


def test_analysis_from_daily_sums(spark, capsys):
    from returnsight.__main__ import main

    base = tempfile.mkdtemp(prefix="returnsight-daily-")
    window = FIXTURE.with_(date_lo="1998-01-01", date_hi="1998-04-01", min_sale_lines=0)
    write_table(fixture_detail(spark, SF001), os.path.join(base, "lines"))
    write_table(fixture_sku(spark, SF001), os.path.join(base, "sku"))
    for lo, hi in (("1998-01-01", "1998-03-01"), ("1998-03-01", "1998-04-01")):
        main(["--detail", os.path.join(base, "lines"), "--append-days", os.path.join(base, "daily"), "--window", lo, hi])
    prod = Source(sku=os.path.join(base, "sku"), daily=os.path.join(base, "daily"))
    got = PL.feature_table(spark, prod, window)
    want = PL.feature_table(spark, SF001, window)
    key = ["sku_key", "product_desc"]
    rows = [f.select(*key, F.round("return_rate", 9), F.round("avg_price_product", 9), "quantity").orderBy(*key).collect() for f in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) > 50
    out = os.path.join(base, "out")
    assert run(spark, prod, window, out, "LR", cross_validate=False, only=["features", "null_counts"]) == ["features", "null_counts"]
    # days appended later count as changed input
    main(["--detail", os.path.join(base, "lines"), "--append-days", os.path.join(base, "daily"), "--window", "1998-04-01", "1998-06-01"])
    longer = window.with_(date_hi="1998-06-01")
    assert PL.feature_table(spark, prod, longer).agg(F.sum("quantity")).first() == PL.feature_table(spark, SF001, longer).agg(F.sum("quantity")).first()
