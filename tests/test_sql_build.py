"""The feature build as Spark SQL statements: same rows as the DataFrame plans, rerunnable,
pushed-down window, one line-table scan, and a report table the top-k reads."""

import os
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.operators import report as R
from returnsight.operators.features import sku_features, sku_features_eager
from returnsight.plans import sql_build as S
from returnsight.session import ensure_checkpoint_dir
from returnsight.sources import fixture_detail, fixture_sku
from tests.conftest import SF001
from tests.test_features import D, frames, line, rows

TEXT = ("product_desc", "sku_color", "sku_size")


def norm(df):
    return rows(df.select(*[c if c in TEXT else F.round(c, 9).alias(c) for c in df.columns]))


def _tables(spark, det, sku):
    """Inline frames as temporary input views, outputs in a schema under the checkpoint folder."""
    schema = "rs_sql_test"
    if not spark.catalog.databaseExists(schema):
        loc = os.path.join(ensure_checkpoint_dir(spark), f"{schema}.db")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{loc}'")
    tag = uuid.uuid4().hex[:8]
    det.createOrReplaceTempView(f"detail_{tag}")
    sku.createOrReplaceTempView(f"sku_{tag}")
    return {
        "detail_table": f"detail_{tag}", "sku_table": f"sku_{tag}",
        "feature_table": f"{schema}.features_{tag}", "report_table": f"{schema}.report_{tag}",
    }


def test_script_equals_dataframe_plans_with_fanout_nulls_and_no_sales(spark):
    lines = [
        line(1, q=2.0, price=5.0), line(1, q=1.0, price=7.0, ret="Y", sale="N", rc="N"), line(1, ecom="N"),
        line(2, sale="N", ret="Y", rc=None), line(2, sale="N", ret="Y", rc="Y"),
        line(3), line(3, ret="Y", sale="N", rc="Y"),
        line(4),
        line(5, ecom="X", rc="?"),
    ]
    skus = [
        (1, "A", "B", 1.0, "b/red/9"),
        (2, "A", "C", 2.0, "b/blue/"),
        (3, "A", "D", 3.0, "b/red/1"), (3, "A", "D", 3.0, "b/red/1"),
        (3, "A", "E", 3.0, "b/red/2"),
        (5, None, "F", 1.0, "only"),
    ]
    det, sku = frames(spark, lines, skus)
    p = FIXTURE.with_(min_sale_lines=-1)
    got = norm(S.build_feature_table(spark, p, **_tables(spark, det, sku)))
    assert got == norm(sku_features(det, sku, p)) == norm(sku_features_eager(det, sku, p))


def test_line_view_equals_line_table(spark):
    det, sku = frames(spark, [line(1, ecom="X", rc=None), line(2)], [(1, "A", "B", 1.0, "b/red/9"), (2, "A", "B", 1.0, "x")])
    t = _tables(spark, det, sku)
    S.line_table(spark, FIXTURE, t["detail_table"], t["sku_table"])
    from returnsight.operators.features import detail_flags

    view = spark.table(S.TMP_VIEW)
    assert view.dtypes == detail_flags(det, sku, FIXTURE).dtypes
    assert rows(view) == rows(detail_flags(det, sku, FIXTURE))


def test_rerun_replaces_the_table(spark):
    lines = [line(1), line(1), line(2)]
    det, sku = frames(spark, lines, [(1, "A", "B", 1.0, "x/y/z"), (2, "A", "B", 1.0, "x/y/z")])
    t = _tables(spark, det, sku)
    first = S.build_feature_table(spark, FIXTURE.with_(min_sale_lines=0), **t)
    assert sorted(r["sku_key"] for r in first.collect()) == [1, 2]
    second = S.build_feature_table(spark, FIXTURE.with_(min_sale_lines=1), **t)
    assert [r["sku_key"] for r in second.collect()] == [1]


_flag = st.sampled_from(["Y", "N", "X", None])
_line = st.tuples(st.integers(1, 4), st.integers(1, 5).map(float), st.integers(1, 400).map(lambda c: c / 4.0), _flag, st.sampled_from(["Y", "N"]), _flag)
_dim = st.tuples(st.integers(1, 5), st.sampled_from(["A", "B", None]), st.sampled_from(["x/red/1", "x/blue/", "x", None]))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_line, min_size=1, max_size=20), st.lists(_dim, min_size=1, max_size=6), st.integers(-1, 3))
def test_script_equals_semi_join_plan_on_random_frames(spark, lines, dims, threshold):
    det = [(k, q, pr, 0.0, 0.0, pr * q, ecom, sale, "Y" if sale == "N" else "N", rc, D) for k, q, pr, ecom, sale, rc in lines]
    d, s = frames(spark, det, [(k, cls, "dept", 1.5, desc) for k, cls, desc in dims])
    p = FIXTURE.with_(min_sale_lines=threshold)
    assert norm(S.build_feature_table(spark, p, **_tables(spark, d, s))) == norm(sku_features(d, s, p))


def test_script_plan_pushes_window_and_scans_lines_once(spark):
    t = S.fixture_tables(spark, SF001)
    args = {
        "detail_table": t["detail_table"], "sku_table": t["sku_table"],
        "date_lo": S._date(FIXTURE.date_lo), "date_hi": S._date(FIXTURE.date_hi), "min_sale_lines": FIXTURE.min_sale_lines,
    }
    df = spark.sql(S.FEATURES_SQL, args=args)
    df.collect()  # runs this DataFrame's own execution, so the final adaptive plan is read
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert plan.count("lineitem.parquet") == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "SortMergeJoin LeftSemi"):
        assert bad not in plan


def test_report_table_and_top_products_match_dataframe_report(spark):
    t = S.fixture_tables(spark, SF001)
    S.build_feature_table(spark, FIXTURE, **t)
    report = S.build_report_table(spark, **t)
    feats = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    assert norm(report) == norm(R.product_summary(feats))
    for pattern in (FIXTURE.family_pattern, FIXTURE.report_brand_pattern):
        got = S.top_products(spark, t["report_table"], pattern, FIXTURE.top_k).collect()
        want = R.top_k(R.matching(R.product_summary(feats), pattern), FIXTURE.top_k).collect()
        assert [r["product_desc"] for r in got] == [r["product_desc"] for r in want]
        assert [round(r["avg_return_rate"], 9) for r in got] == [round(r["avg_return_rate"], 9) for r in want]


def test_command_line_runs_the_script_against_a_schema(spark, capsys):
    import json

    from returnsight.__main__ import main

    schema = "rs_cli_test"
    if not spark.catalog.databaseExists(schema):
        loc = os.path.join(ensure_checkpoint_dir(spark), f"{schema}.db")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{loc}'")
    tables = S.reference_tables(schema)
    for name, df in ((tables["detail_table"], fixture_detail(spark, SF001)), (tables["sku_table"], fixture_sku(spark, SF001))):
        spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:t)", args={"t": name})
        df.write.saveAsTable(name)
    main(["--sql-schema", schema, "--window", FIXTURE.date_lo, FIXTURE.date_hi, "--min-sale-lines", str(FIXTURE.min_sale_lines)])
    printed = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert printed["tables"] == [tables["feature_table"], tables["report_table"]]
    feats = spark.table(tables["feature_table"])
    assert feats.count() == 116  # the documented sf0.001 count for this window and threshold
    want = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    assert norm(feats) == norm(want)
    assert spark.table(tables["report_table"]).count() == R.product_summary(want).count()


def test_published_tables_are_views_that_are_switched(spark):
    t = S.fixture_tables(spark, SF001)
    root = os.path.join(ensure_checkpoint_dir(spark), "published-" + t["feature_table"].split(".")[0])
    S.publish_tables(spark, FIXTURE.with_(min_sale_lines=10_000), root, **t)
    reader = spark.table(t["report_table"])
    S.publish_tables(spark, FIXTURE, root, **t)
    want = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    assert reader.count() == 0 and norm(spark.table(t["feature_table"])) == norm(want)
    assert norm(spark.table(t["report_table"])) == norm(R.product_summary(want))
