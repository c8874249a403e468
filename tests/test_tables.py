"""Daily sums, co-located tables and replacing a table without a gap."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.functions import round_doubles
from returnsight.operators.features import active_skus, sku_features_eager
from returnsight.plans import colocated as CO
from returnsight.plans import daily as DP
from returnsight.plans import publish as PB
from returnsight.session import ensure_checkpoint_dir, shared_folder
from returnsight.sources import fixture_detail, fixture_sku
from tests.conftest import SF001

P = FIXTURE.with_(min_sale_lines=1)
DETAIL = "sku_key long, quantity double, plu_amt double, tran_discount_amt double, override_amt double, extended_amt double, ecom string, sale string, `return` string, receipted string, date_pos timestamp_ntz"


@pytest.fixture(autouse=True)
def shared(spark):
    ensure_checkpoint_dir(spark)


def rows_of(df):
    return sorted(map(tuple, round_doubles(df).collect()), key=str)


def lines(spark, n, day, sku=None):
    at = dt.datetime.fromisoformat(day)
    rows = [(i % 5 if sku is None else sku, 1.0 + i % 3, 2.5, 0.0, 0.0, 2.5, "YN"[i % 2], "YN"[i % 4 == 0], "NY"[i % 4 == 0], [None, "Y", "N"][i % 3], at + dt.timedelta(hours=i % 24)) for i in range(n)]
    return spark.createDataFrame(rows, DETAIL)


def sku(spark):
    rows = [(i, "shoes", f"d{i}", 1.0, f"b/red/{i}") for i in range(5)] + [(2, "shoes", "again", 1.0, "b/blue/2")]
    return spark.createDataFrame(rows, "sku_key long, class_desc string, department_desc string, sku_cost double, sku_desc string")


def test_daily_sums_answer_windows_like_the_lines(spark):
    path, window = shared_folder(spark, "daily"), P.with_(date_lo="2020-01-01", date_hi="2020-01-05")
    days = [lines(spark, 40 + 10 * i, f"2020-01-0{i + 1}") for i in range(4)]
    hot = lines(spark, 200, "2020-01-02", sku=3)  # a SKU with most of a day
    early = days[0].unionByName(days[1]).unionByName(hot).unionByName(days[2])
    DP.append_days(spark, early, path, window.with_(date_hi="2020-01-04"))
    for lo, hi in (("2020-01-01", "2020-01-04"), ("2020-01-02", "2020-01-03"), ("2020-01-03", "2020-01-09")):
        w = window.with_(date_lo=lo, date_hi=hi)
        assert rows_of(DP.features_from_daily(spark, path, sku(spark), w)) == rows_of(sku_features_eager(early, sku(spark), w))
    # an appended day, a day corrected, a window without lines; then all of it over again
    late = days[3].unionByName(lines(spark, 7, "2020-01-03"))
    everything = days[0].unionByName(days[1]).unionByName(hot).unionByName(late)
    for _ in range(2):
        DP.append_days(spark, late, path, window.with_(date_lo="2020-01-03"))
        DP.append_days(spark, late, path, window.with_(date_lo="2021-01-03", date_hi="2021-02-01"))
        assert rows_of(DP.features_from_daily(spark, path, sku(spark), window)) == rows_of(sku_features_eager(everything, sku(spark), window))


def test_only_the_windows_days_are_read(spark):
    path = shared_folder(spark, "daily")
    DP.append_days(spark, fixture_detail(spark, SF001), path, FIXTURE)
    window = FIXTURE.with_(date_lo="1998-02-01", date_hi="1998-02-08")
    df = DP.window_partials(spark, path, window)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert re.search(r"PartitionFilters: \[.*day#\d+ >= 1998-02-01.*day#\d+ < 1998-02-08", text) and "lineitem" not in text
    leaf = re.search(r"number of files read: (\d+)|", text)
    assert leaf is not None
    days = {f.split("day=")[1][:10] for f in df.inputFiles()}
    assert all("1997" <= d for d in days)
    read = spark.read.parquet(path).filter("day >= '1998-02-01' AND day < '1998-02-08'").select("day").distinct().count()
    assert 0 < read <= 7


def test_windows_of_parts_of_days_are_refused(spark):
    with pytest.raises(ValueError, match="whole days"):
        DP.window_partials(spark, "/nowhere", P.with_(date_lo="2020-01-01 12:00:00"))


@pytest.fixture(scope="module")
def by_sku(spark):
    ensure_checkpoint_dir(spark)
    schema = f"t_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {schema} LOCATION '{shared_folder(spark, schema)}'")
    return CO.write_colocated(fixture_detail(spark, SF001), fixture_sku(spark, SF001), f"{schema}.by_sku", 4)


def test_colocated_tables_give_the_same_features(spark, by_sku):
    detail, dim = fixture_detail(spark, SF001), fixture_sku(spark, SF001)
    assert rows_of(CO.colocated_features(spark, by_sku, FIXTURE)) == rows_of(sku_features_eager(detail, dim, FIXTURE))
    assert rows_of(CO.colocated_active_skus(spark, by_sku, FIXTURE)) == rows_of(active_skus(detail, dim, FIXTURE))
    assert 0.2 < CO.largest_bucket_share(spark, by_sku, 4) < 0.5


def test_colocated_plans_have_no_exchange(spark, by_sku):
    for df in (CO.colocated_features(spark, by_sku, FIXTURE), CO.colocated_active_skus(spark, by_sku, FIXTURE)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_publishing_replaces_without_a_gap(spark):
    name, root = f"v_{uuid.uuid4().hex[:12]}", shared_folder(spark, "published")
    first = PB.publish(spark.range(10), name, root, keep=2)
    reader = spark.table(name)  # opened before the rebuild
    PB.publish(spark.range(20), name, root, keep=2)
    assert reader.count() == 10 and spark.table(name).count() == 20
    broken = spark.range(5).select(F.raise_error(F.lit("broken build")).alias("id"))
    with pytest.raises(Exception, match="broken build"):
        PB.publish(broken, name, root, keep=2)
    assert spark.table(name).count() == 20 and len(PB.versions(spark, root)) == 2
    for n in (30, 40):
        PB.publish(spark.range(n), name, root, keep=2)
    assert spark.table(name).count() == 40
    kept = PB.versions(spark, root)
    assert len(kept) == 3 and not any(first.rsplit("/", 1)[1] in p for p in kept)
    spark.sql(f"DROP VIEW {name}")
