"""Feature build on hand-made frames: flag decoding, derived attributes, fan-out, threshold."""

import datetime as dt

from pyspark.sql import functions as F

from returnsight.config import FIXTURE
from returnsight.operators.features import active_skus, detail_flags, sku_features, sku_features_eager

P = FIXTURE.with_(min_sale_lines=1)
D = dt.datetime(1998, 6, 1)

DETAIL_SCHEMA = (
    "sku_key long, quantity double, plu_amt double, tran_discount_amt double, override_amt double, "
    "extended_amt double, ecom string, sale string, return string, receipted string, date_pos timestamp_ntz"
)
SKU_SCHEMA = "sku_key long, class_desc string, department_desc string, sku_cost double, sku_desc string"


def line(k, q=1.0, price=10.0, ecom="Y", sale="Y", ret="N", rc="Y", d=D):
    return (k, q, price, 0.0, 0.0, price * q, ecom, sale, ret, rc, d)


def frames(spark, lines, skus):
    return spark.createDataFrame(lines, DETAIL_SCHEMA), spark.createDataFrame(skus, SKU_SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_flag_outside_yn_is_null(spark):
    det, sku = frames(spark, [line(1, ecom="X", rc=None)], [(1, "A", "B", 1.0, "b/red/9")])
    r = detail_flags(det, sku, P).first()
    assert r["ecom"] is None and r["receipted"] is None and r["sale"] == 1 and r["return"] == 0


def test_derived_attributes(spark):
    skus = [(1, "A", "B", 1.0, "b/red/9"), (2, None, "B", 1.0, "only"), (3, "A", "B", 1.0, "b/c")]
    det, sku = frames(spark, [line(1), line(2), line(3)], skus)
    got = {r["sku_key"]: (r["product_desc"], r["sku_color"], r["sku_size"]) for r in detail_flags(det, sku, P).collect()}
    assert got[1] == ("A B", "red", "9")
    assert got[2] == (None, "", "")  # NULL text stays NULL; missing parts are ''
    assert got[3] == ("A B", "c", "")


def test_date_window_is_half_open(spark):
    lo, hi = dt.datetime(1997, 1, 1), dt.datetime(2000, 1, 1)
    det, sku = frames(spark, [line(1, d=lo), line(2, d=hi)], [(1, "A", "B", 1.0, "x/y/z"), (2, "A", "B", 1.0, "x/y/z")])
    assert [r["sku_key"] for r in detail_flags(det, sku, P).collect()] == [1]


def test_threshold_counts_sale_lines_not_units(spark):
    p = FIXTURE.with_(min_sale_lines=2)
    lines = [line(1, q=50.0), line(1, q=50.0), line(2), line(2), line(2)]
    det, sku = frames(spark, lines, [(1, "A", "B", 1.0, "x/y/z"), (2, "A", "B", 1.0, "x/y/z")])
    assert [r["sku_key"] for r in active_skus(det, sku, p).collect()] == [2]


def test_both_plans_agree_with_fanout_nulls_and_no_sales(spark):
    lines = [
        line(1, q=2.0, price=5.0), line(1, q=1.0, price=7.0, ret="Y", sale="N", rc="N"), line(1, ecom="N"),
        line(2, sale="N", ret="Y", rc=None), line(2, sale="N", ret="Y", rc="Y"),  # no sales at all
        line(3), line(3, ret="Y", sale="N", rc="Y"),
        line(4),  # not in the dimension
    ]
    skus = [
        (1, "A", "B", 1.0, "b/red/9"),
        (2, "A", "C", 2.0, "b/blue/"),
        (3, "A", "D", 3.0, "b/red/1"), (3, "A", "D", 3.0, "b/red/1"),  # exact duplicate: fan-out
        (3, "A", "E", 3.0, "b/red/2"),  # a second group for the same key
    ]
    det, sku = frames(spark, lines, skus)
    p0 = FIXTURE.with_(min_sale_lines=-1)  # keep every SKU, even one without sale lines
    text = ("product_desc", "sku_color", "sku_size")

    def norm(df):
        return rows(df.select(*[c if c in text else F.round(c, 9).alias(c) for c in df.columns]))

    a, b = norm(sku_features(det, sku, p0)), norm(sku_features_eager(det, sku, p0))
    assert a == b
    by = {(r[0], r[2]): r for r in a}
    # SKU 2 has no sale lines: NULL price, units and online share; its return rate is 1
    no_sales = by[(2, "A C")]
    assert no_sales[1] == 1.0 and no_sales[6] is None and no_sales[7] is None and no_sales[8] is None
    # an exact duplicate dimension row doubles the units but leaves the averages alone
    dup = by[(3, "A D")]
    assert dup[7] == 2.0 and dup[1] == 0.5
    # SKU 4 has no dimension row: dropped by the inner join
    assert all(k[0] != 4 for k in by)


def test_fixture_counts_match_documented_numbers(spark):
    from returnsight.sources import fixture_detail, fixture_sku
    from tests.conftest import SF001

    f = sku_features_eager(fixture_detail(spark, SF001), fixture_sku(spark, SF001), FIXTURE)
    assert f.count() == 116
    assert f.filter(F.col("receipted_rate").isNull()).count() == 2


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_flag = st.sampled_from(["Y", "N", "X", None])
_line = st.tuples(
    st.integers(1, 5), st.integers(1, 5).map(float), st.integers(1, 400).map(lambda c: c / 4.0),
    _flag, st.sampled_from(["Y", "N"]), _flag,
)
_dim = st.tuples(st.integers(1, 6), st.sampled_from(["A", "B", None]), st.sampled_from(["x/red/1", "x/blue/", "x", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_line, min_size=1, max_size=30), st.lists(_dim, min_size=1, max_size=8), st.integers(-1, 3))
def test_eager_plan_equals_semi_join_plan(spark, lines, dims, threshold):
    det = [
        (k, q, price, 0.0, 0.0, price * q, ecom, sale, "Y" if sale == "N" else "N", rc, D)
        for k, q, price, ecom, sale, rc in lines
    ]
    skus = [(k, cls, "dept", 1.5, desc) for k, cls, desc in dims]
    d, s = frames(spark, det, skus)
    p = FIXTURE.with_(min_sale_lines=threshold)
    text = ("product_desc", "sku_color", "sku_size")

    def norm(df):
        return rows(df.select(*[c if c in text else F.round(c, 9).alias(c) for c in df.columns]))

    assert norm(sku_features(d, s, p)) == norm(sku_features_eager(d, s, p))
