"""Physical-plan properties: pushdown, pruning, one line-table scan, no cartesian or Python rows."""

import os

from returnsight.config import FIXTURE
from returnsight.operators.features import sku_features_eager
from returnsight.sources import fixture_detail, fixture_sku
from tests.conftest import SF001


def _plan(df) -> str:
    """The executed plan; for an adaptive plan, only its final section."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_date_window_pushed_into_scan(spark):
    df = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    plan = _plan(df)
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_single_scan_reads_lines_once_without_cartesian_or_python(spark):
    df = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    df.collect()
    plan = _plan(df)
    assert plan.count("lineitem.parquet") == 1
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_line_scan_reads_only_needed_columns(spark):
    df = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_suppkey" not in plan and "l_discount" not in plan


def _final_plan_of_run(df) -> str:
    # collect() runs the DataFrame's own query execution, so the plan read back is the final
    # adaptive plan (a write command may plan and run a separate execution)
    df.collect()
    plan = _plan(df)
    assert "isFinalPlan=false" not in plan
    return plan


def test_no_registered_query_plans_a_cartesian_or_nested_loop_join(spark):
    import __spark_entry__ as E

    slow = {"cv_summary", "gbt_cv_summary", "rf_cv_summary"}
    offenders = []
    for name, q in E.queries().items():
        if name in slow:
            continue
        plan = _final_plan_of_run(q(spark, SF001))
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan or "BatchEvalPython" in plan:
            offenders.append(name)
    assert offenders == []


def _exchange_records(df) -> list[int]:
    """Records written by every shuffle of the executed (final adaptive) plan."""
    root = df._jdf.queryExecution().executedPlan()
    node = root.finalPhysicalPlan() if "Adaptive" in root.getClass().getName() else root
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if n.nodeName() == "Exchange":
            out.append(int(n.metrics().apply("shuffleRecordsWritten").value()))
        kids = n.children()
        stack.extend(kids.apply(i) for i in range(kids.size()))
        if n.nodeName().startswith(("ShuffleQueryStage", "BroadcastQueryStage")):
            stack.append(n.plan())
    return out


def test_a_sku_with_a_third_of_all_lines_reaches_the_shuffle_pre_aggregated(spark):
    from returnsight.config import FIXTURE
    from tests.test_features import frames, line

    hot, cold = 1000, 2000
    lines = [line(1, q=2.0) for _ in range(hot)] + [line(k) for k in range(2, cold + 2)]
    skus = [(k, "A", "B", 1.0, "x/y/z") for k in range(1, cold + 2)]
    det, sku = frames(spark, lines, skus)
    map_tasks = det.rdd.getNumPartitions()
    df = sku_features_eager(det, sku, FIXTURE.with_(min_sale_lines=0))
    df.write.format("noop").mode("overwrite").save()
    records = _exchange_records(df)
    assert records, "expected at least one shuffle"
    # the hot SKU's 1000 lines cross the shuffle as at most one partial row per map task
    assert max(records) <= cold + map_tasks < hot + cold
    got = df.filter("sku_key = 1").first()
    assert got["quantity"] == 2.0 * hot and got["return_rate"] == 0.0


def test_shuffle_sizing_follows_scanned_bytes_and_keeps_a_user_value(spark):
    from returnsight.session import INITIAL_PARTITIONS, scan_bytes, size_shuffles

    det = fixture_detail(spark, SF001)
    size = scan_bytes(det)
    files = sum(os.path.getsize(f"{SF001}/{t}.parquet") for t in ("lineitem", "orders"))
    assert size == files
    wide = spark.read.parquet(f"{SF001}/lineitem.parquet")
    try:
        spark.conf.unset(INITIAL_PARTITIONS)
        assert size_shuffles(spark, det) == spark.sparkContext.defaultParallelism  # tiny input
        # a value set by an earlier call is sized anew for another input
        assert size_shuffles(spark, det, bytes_per_partition=1000) == -(-size // 1000)
        assert size_shuffles(spark, wide, bytes_per_partition=1000) == -(-scan_bytes(wide) // 1000) != -(-size // 1000)
        spark.conf.set(INITIAL_PARTITIONS, "37")
        assert size_shuffles(spark, det) == 37
    finally:
        spark.conf.unset(INITIAL_PARTITIONS)


def test_memo_follows_the_input_files(spark, tmp_path):
    from returnsight.plans import pipeline as PL
    from returnsight.plans.model_queries import study
    from returnsight.sources import Source, fixture_detail, fixture_sku

    lines, skus = str(tmp_path / "lines"), str(tmp_path / "skus")
    fixture_sku(spark, SF001).write.parquet(skus)
    fixture_detail(spark, SF001).write.parquet(lines)
    source, p = Source(detail=lines, sku=skus), FIXTURE.with_(rf_trees=2)
    before = PL.feature_table(spark, source, p).agg({"quantity": "sum"}).first()[0]
    assert PL.feature_table(spark, source, p) is PL.feature_table(spark, source, p)
    old = study(spark, source, p)
    assert study(spark, source, p) is old
    rows = old.predictions("RF").count()
    more = fixture_detail(spark, SF001)
    more.unionByName(more.filter("sku_key % 2 = 0")).write.mode("overwrite").parquet(lines)
    after = PL.feature_table(spark, source, p).agg({"quantity": "sum"}).first()[0]
    assert after > 1.2 * before
    new = study(spark, source, p)
    assert new is not old and new.predictions("RF").count() != rows or new.scored("RF").count() != old.scored("RF").count()
    PL.forget(spark)
    assert study(spark, source, p) is not new


def _hot_frames(spark):
    from tests.test_features import frames, line

    lines = [line(1, q=2.0) for _ in range(20_000)] + [line(2 + k % 2000) for k in range(40_000)]
    return frames(spark, lines, [(k, "A", "B", 1.0, "x/y/z") for k in range(1, 2002)])


def test_a_hot_sku_is_split_beyond_the_broadcast_bounds(spark):
    from returnsight.operators import features as FT

    det, sku = _hot_frames(spark)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    }
    was = {k: spark.conf.get(k, None) for k in conf}
    old = FT.BROADCAST_DIMENSION_ROWS
    try:
        FT.BROADCAST_DIMENSION_ROWS = 0
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = FT.sku_features(det.repartition(16), sku, FIXTURE.with_(min_sale_lines=0))
        df.collect()
        assert "skew=true" in _plan(df)
        active = FT.active_skus(det, sku, FIXTURE.with_(min_sale_lines=0))
        active.collect()
        # no shuffle carries lines: at most a row per key and map task
        assert max(_exchange_records(active)) <= 2001 * det.rdd.getNumPartitions() < 60_000
        assert {r["sku_key"]: r["sale_lines"] for r in active.collect()}[1] == 20_000
    finally:
        FT.BROADCAST_DIMENSION_ROWS = old
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_broadcasts_check_bytes_too(spark):
    from returnsight.operators import features as FT

    df = spark.range(10).selectExpr("id", "repeat('x', 1000) AS t")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().analyzed().toString().lower()
    old = FT.BROADCAST_DIMENSION_BYTES
    try:
        assert hinted(FT.broadcast_if_small(df))
        FT.BROADCAST_DIMENSION_BYTES = 10_000
        assert not hinted(FT.broadcast_if_small(df))
    finally:
        FT.BROADCAST_DIMENSION_BYTES = old


def test_scores_read_one_scoring_pass(spark):
    from returnsight.plans.evaluate import Study

    s = Study(spark, SF001, FIXTURE.with_(rf_trees=2))
    assert s.scored("RF") is s.scored("RF")
    plan = s.scores("RF")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and plan.count("LogicalRDD") + plan.count("Scan") <= 1


def test_label_encoding_broadcasts_a_checked_dictionary_instead_of_shuffling_by_category(spark):
    from returnsight.operators.prepare import label_encode
    from returnsight.plans.pipeline import feature_table

    df = label_encode(feature_table(spark, SF001, FIXTURE))
    df.collect()
    plan = _plan(df)
    assert "hashpartitioning(coalesce(sku_size" not in plan and "hashpartitioning(coalesce(sku_color" not in plan
    assert plan.count("BroadcastHashJoin [coalesce(sku_") == 2


def test_line_level_join_broadcasts_a_counted_dimension(spark):
    from returnsight.operators import features as FT
    from returnsight.operators.features import detail_flags

    det, sku = fixture_detail(spark, SF001), fixture_sku(spark, SF001)
    df = detail_flags(det, sku, FIXTURE)
    df.collect()
    assert "BroadcastHashJoin [sku_key" in _plan(df)
    # beyond the bound the join is the planner's choice: no broadcast hint in the logical plan
    old = FT.BROADCAST_DIMENSION_ROWS
    try:
        FT.BROADCAST_DIMENSION_ROWS = 0
        hinted = detail_flags(det, sku, FIXTURE)._jdf.queryExecution().analyzed().toString()
        assert "broadcast" not in hinted.lower()
    finally:
        FT.BROADCAST_DIMENSION_ROWS = old


def test_semi_join_form_broadcasts_the_counted_active_set(spark):
    from returnsight.operators.features import sku_features

    df = sku_features(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    df.collect()
    plan = _plan(df)
    assert "LeftSemi" in plan and "SortMergeJoin" not in plan
