"""The query catalogue: every operator as a named (spark, sf_dir) -> DataFrame query, each with
its DuckDB SQL twin where one exists. Float outputs are rounded to 6 decimals on both sides."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight import oracle as O
from returnsight.config import FIXTURE, Params, predictors
from returnsight.functions import round_doubles
from returnsight.operators import explore as X
from returnsight.operators import metrics as M
from returnsight.operators import prepare as P
from returnsight.operators import report as R
from returnsight.operators.features import active_skus, detail_flags, sku_features, sku_features_eager
from returnsight.operators.ordering import category_order, category_sums
from returnsight.operators.split import fold_assignment, holdout_split
from returnsight.plans import colocated as CO
from returnsight.plans import daily as DP
from returnsight.plans import explain as EX
from returnsight.plans import pipeline as PL
from returnsight.plans import publish as PB
from returnsight.plans.model_queries import study
from returnsight.plans.models import summarise_folds
from returnsight.session import materialise, shared_folder
from returnsight.sources import as_source, fixture_detail, fixture_sku

Query = Callable[[SparkSession, str], DataFrame]

#: Where the daily sums of the year are first cut off, and from where they are appended.
APPENDED_FROM, APPENDED_AGAIN = "1998-09-01", "1998-08-20"


def year_params(p: Params) -> Params:
    """One year inside the test window."""
    return p.with_(date_lo="1998-01-01", date_hi="1999-01-01", min_sale_lines=3)


def weeks_params(p: Params) -> Params:
    """Some weeks of that year, on both sides of where days are appended."""
    return p.with_(date_lo="1998-06-15", date_hi="1998-10-01", min_sale_lines=0)


DESCRIBE_COLUMNS = [
    "sku_key", "return_rate", "sku_color", "sku_size", "sku_cost", "avg_price_product",
    "quantity", "ecom_rate", "receipted_rate", "label",
]
QUARTILE_COLUMNS = ["ecom_rate", "return_rate", "receipted_rate", "quantity", "avg_price_product"]


def _inputs(spark: SparkSession, sf_dir: str):
    return fixture_detail(spark, sf_dir), fixture_sku(spark, sf_dir)


def _scored(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Deterministic stand-in for a model: score = online share, predicted positive above 0.5."""

    def build() -> DataFrame:
        s = PL.labelled(spark, sf_dir, p).select(
            "sku_key", "label", F.col("ecom_rate").alias("score"),
            (F.col("ecom_rate") > F.lit(0.5)).cast("int").alias("prediction"),
        )
        return materialise(holdout_split(s, "sku_key", p.test_fraction, p.split_seed))

    return PL.memo(spark, as_source(sf_dir), ("scored", p), build)


#: A linear model with given weights, and two given trees over given columns, for explanations that
#: SQL can express as well: ecom_rate <= 0.5 ? (quantity <= 5 ? 1 : -0.5) : 0.25, and
#: avg_price_product <= 7.2 ? 0.7 : -0.3; the shares are the training rows that go left.
FIXED_WEIGHTS = {"receipted_rate": 0.8, "ecom_rate": -1.25, "quantity": 0.5, "sku_size": 0.01}
FIXED_INTERCEPT = -0.4
FIXED_TREE_COLUMNS = ["ecom_rate", "quantity", "avg_price_product"]
FIXED_TREES = EX.TreeTables(
    [1.0, 0.5],
    [
        [
            EX.LeafPath(1.0, [(0, 0.5, True, 0.6), (1, 5.0, True, 0.5)]),
            EX.LeafPath(-0.5, [(0, 0.5, True, 0.6), (1, 5.0, False, 0.5)]),
            EX.LeafPath(0.25, [(0, 0.5, False, 0.4)]),
        ],
        [EX.LeafPath(0.7, [(2, 7.2, True, 0.4)]), EX.LeafPath(-0.3, [(2, 7.2, False, 0.6)])],
    ],
    1.0,
    3,
)


def spark_queries(p: Params = FIXTURE) -> dict[str, Query]:
    def q_detail_flags(spark, d):
        # products and quotients of stored values: bit-identical across engines, so not rounded
        return detail_flags(*_inputs(spark, d), p)

    def q_active_skus(spark, d):
        return active_skus(*_inputs(spark, d), p)

    def q_sku_features(spark, d):
        return round_doubles(sku_features(*_inputs(spark, d), p))

    def q_sku_features_single_scan(spark, d):
        return round_doubles(sku_features_eager(*_inputs(spark, d), p))

    def q_sku_features_streaming(spark, d):
        from returnsight.streaming import streaming_sku_features

        return round_doubles(streaming_sku_features(spark, d, p))

    def q_feature_table_readback(spark, d):
        # CTAS into the shared folder twice, the second replacing the first, then the final read-back
        from returnsight.sources import read_table, write_table

        target = shared_folder(spark, "parameters_for_analysis_cln")
        for _ in range(2):
            write_table(sku_features_eager(*_inputs(spark, d), p), target)
        return round_doubles(read_table(spark, target))

    def _sql_tables(spark, d):
        # feature and report table of the SQL script, built once for the queries that read them
        from returnsight.plans import sql_build as S

        def build():
            t = S.fixture_tables(spark, d)
            S.build_feature_table(spark, p, **t)
            S.build_report_table(spark, **t)
            return t

        return PL.memo(spark, as_source(d), ("sql", p), build)

    def q_line_table_sql(spark, d):
        # the intermediate as the SQL script builds it: a temporary view over the two inputs
        from returnsight.plans import sql_build as S

        t = S.fixture_tables(spark, d)
        return S.line_table(spark, p, t["detail_table"], t["sku_table"])

    def q_feature_table_sql(spark, d):
        # the SQL script: drop, CTAS into a catalog table (shared location), read back
        from returnsight.plans import sql_build as S

        return round_doubles(S.build_feature_table(spark, p, **S.fixture_tables(spark, d)))

    def q_report_table_sql(spark, d):
        return round_doubles(spark.table(_sql_tables(spark, d)["report_table"]))

    def q_top_family_sql(spark, d):
        from returnsight.plans import sql_build as S

        top = S.top_products(spark, _sql_tables(spark, d)["report_table"], p.family_pattern, p.top_k)
        return round_doubles(top.select("product_desc", "avg_return_rate"))

    def q_top_brand_sql(spark, d):
        from returnsight.plans import sql_build as S

        return round_doubles(S.top_products(spark, _sql_tables(spark, d)["report_table"], p.report_brand_pattern, p.top_k))

    def _daily(spark, d):
        # daily sums up to a day inside the window, then the rest appended, some days over again
        def build():
            path = shared_folder(spark, "daily")
            detail, _ = _inputs(spark, d)
            DP.append_days(spark, detail, path, year_params(p).with_(date_hi=APPENDED_FROM))
            DP.append_days(spark, detail, path, year_params(p).with_(date_lo=APPENDED_AGAIN))
            return path

        return PL.memo(spark, as_source(d), ("daily", p), build)

    def q_daily_window_features(spark, d):
        return round_doubles(DP.features_from_daily(spark, _daily(spark, d), fixture_sku(spark, d), weeks_params(p)))

    def q_daily_year_features(spark, d):
        return round_doubles(DP.features_from_daily(spark, _daily(spark, d), fixture_sku(spark, d), year_params(p)))

    def _colocated(spark, d):
        def build():
            schema = f"returnsight_{uuid.uuid4().hex[:12]}"
            location = shared_folder(spark, schema).replace("'", "")
            spark.sql(f"CREATE DATABASE {schema} LOCATION '{location}'")
            return CO.write_colocated(*_inputs(spark, d), f"{schema}.by_sku", 8)

        return PL.memo(spark, as_source(d), ("colocated",), build)

    def q_colocated_features(spark, d):
        return round_doubles(CO.colocated_features(spark, _colocated(spark, d), p))

    def q_colocated_active_skus(spark, d):
        return CO.colocated_active_skus(spark, _colocated(spark, d), p)

    def q_published_features(spark, d):
        # two versions, the second in place of the first
        name = f"returnsight_{uuid.uuid4().hex[:12]}"
        root = shared_folder(spark, name)
        for window in (year_params(p), p):
            PB.publish(sku_features_eager(*_inputs(spark, d), window), name, root)
        return round_doubles(spark.table(name))

    def q_null_mask(spark, d):
        f = PL.feature_table(spark, d, p)
        return f.select("sku_key", (F.col("receipted_rate").isNull() | F.isnan("receipted_rate")).alias("receipted_rate_missing"))

    def q_schema_info(spark, d):
        return X.schema_info(PL.feature_table(spark, d, p))

    def q_return_label(spark, d):
        lab = PL.labelled(spark, d, p)
        return round_doubles(lab.select("sku_key", "return_rate", "label"))

    def q_label_counts(spark, d):
        return P.label_counts(PL.labelled(spark, d, p))

    def q_encoded_categories(spark, d):
        return P.encoding_dictionary(PL.feature_table(spark, d, p))

    def q_log_features(spark, d):
        f = PL.feature_table(spark, d, p)
        out = P.log_columns(f, ["quantity", "avg_price_product", "receipted_rate"], in_place=False)
        return round_doubles(out.select("sku_key", "ln_quantity", "ln_avg_price_product", "ln_receipted_rate"))

    def q_family_flag(spark, d):
        return P.text_flags(PL.feature_table(spark, d, p), p).select("sku_key", "product_desc", "footwear")

    def q_brand_flag(spark, d):
        return P.text_flags(PL.feature_table(spark, d, p), p).select("sku_key", "product_desc", "brand")

    def _predictor_set(variant):
        return lambda spark, d: round_doubles(PL.logged(spark, d, p).select("sku_key", "label", *predictors(variant)))

    q_predictor_set = _predictor_set("Footwear")
    q_predictor_set_all = _predictor_set("All")
    q_predictor_set_brand = _predictor_set("Brand")

    def q_midpoint_quartiles(spark, d):
        before = PL.logged(spark, d, p)
        b = P.midpoint_bounds(before, QUARTILE_COLUMNS, p.iqr_factor, nan_policy="propagate")
        rows = [(c, *b[c]) for c in QUARTILE_COLUMNS]
        out = spark.createDataFrame(rows, "column_name string, q1 double, q3 double, lower_bound double, upper_bound double")
        return round_doubles(out)

    def q_iqr_filtered(spark, d):
        before = PL.logged(spark, d, p)
        out = P.iqr_filter(before, p.iqr_columns, p.iqr_factor)
        return round_doubles(out.select("sku_key", "label", "ecom_rate", "quantity", "avg_price_product"))

    def q_imputed(spark, d):
        prep = PL.prepared(spark, d, p)
        return round_doubles(prep.cleaned.select("sku_key", "receipted_rate"))

    def q_zscores(spark, d):
        return round_doubles(P.zscores(PL.prepared(spark, d, p).cleaned))

    def q_null_counts(spark, d):
        return X.null_counts(PL.feature_table(spark, d, p))

    def q_null_columns(spark, d):
        return round_doubles(X.columns_with_nulls(PL.feature_table(spark, d, p)))

    def q_describe(spark, d):
        return round_doubles(X.describe(PL.encoded(spark, d, p), DESCRIBE_COLUMNS))

    def q_correlation(spark, d):
        return round_doubles(X.correlation(PL.encoded(spark, d, p), predictors("All")))

    def q_box_stats(spark, d):
        before = PL.logged(spark, d, p)
        return round_doubles(X.box_stats(before, predictors("All")))

    def q_holdout_split(spark, d):
        f = PL.feature_table(spark, d, p)
        return holdout_split(f, "sku_key", p.test_fraction, p.split_seed).select("sku_key", "is_test")

    def q_fold_assignment(spark, d):
        f = PL.feature_table(spark, d, p)
        return fold_assignment(f, "sku_key", p.n_folds, p.fold_seed).select("sku_key", "fold")

    def q_category_order(spark, d):
        # as the boosted trees learn it from the training rows
        order = category_order(category_sums(study(spark, d, p).train, P.ENCODED_COLUMNS))
        return round_doubles(order.select("column_name", F.col("code").cast("int").alias("code"), "n", "label_mean", "place", "unseen"))

    def q_accuracy(spark, d):
        s = _scored(spark, d, p)
        parts = [
            M.accuracy(s.filter(~F.col("is_test"))).select(F.lit("train").alias("dataset"), "*"),
            M.accuracy(s.filter(F.col("is_test"))).select(F.lit("test").alias("dataset"), "*"),
            M.accuracy(s).select(F.lit("all").alias("dataset"), "*"),
        ]
        return round_doubles(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    def q_balanced_accuracy(spark, d):
        return round_doubles(M.balanced_accuracy(_scored(spark, d, p).filter(F.col("is_test"))))

    def q_confusion(spark, d):
        return M.confusion(_scored(spark, d, p).filter(F.col("is_test")))

    def q_class_report(spark, d):
        return round_doubles(M.class_report(_scored(spark, d, p).filter(F.col("is_test"))))

    def q_roc_points(spark, d):
        return round_doubles(M.roc_points(_scored(spark, d, p).filter(F.col("is_test"))))

    def q_roc_corners(spark, d):
        return round_doubles(M.roc_points(_scored(spark, d, p).filter(F.col("is_test")), drop_intermediate=True))

    def q_roc_auc(spark, d):
        return round_doubles(M.roc_auc(_scored(spark, d, p).filter(F.col("is_test"))))

    def q_fold_summary(spark, d):
        # the cross-validation summary of a fixed predictor, fold by fold
        lab = _scored(spark, d, p).drop("is_test")
        folds = fold_assignment(lab, "sku_key", p.n_folds, p.fold_seed)
        per_fold = folds.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
        return round_doubles(summarise_folds(per_fold.withColumn("dataset", F.lit("all"))))

    def q_fixed_prediction_head(spark, d):
        test = _scored(spark, d, p).filter("is_test").drop("is_test")
        return round_doubles(test.orderBy("sku_key").limit(50))

    def _linear(spark, d, frame=None):
        # the linear model's closed form with fixed weights, against the training rows' means
        s = study(spark, d, p)
        return EX.weights_shap(s.frame if frame is None else frame(s.frame), FIXED_WEIGHTS, FIXED_INTERCEPT, s.train)

    def q_linear_explanation(spark, d):
        long, base = _linear(spark, d)
        return round_doubles(long.withColumn("base_value", F.lit(base)))

    def q_linear_explanation_global(spark, d):
        return round_doubles(EX.global_importance(_linear(spark, d)[0]))

    def q_linear_explanation_class0(spark, d):
        return round_doubles(EX.for_class(_linear(spark, d)[0], 0))

    def q_linear_explanation_rows(spark, d):
        return round_doubles(EX.one_row(*_linear(spark, d, EX.picked_rows)))

    def q_tree_explanation(spark, d):
        # two fixed trees through the code that explains fitted ones
        s = study(spark, d, p)
        long, base = EX.tables_shap(s.frame, FIXED_TREES, FIXED_TREE_COLUMNS)
        return round_doubles(long.withColumn("base_value", F.lit(base)))

    def q_tree_explanation_background(spark, d):
        # the same trees against all training rows
        s = study(spark, d, p)
        long, base = EX.tables_background_shap(s.frame, FIXED_TREES, FIXED_TREE_COLUMNS, s.train)
        return round_doubles(long.withColumn("base_value", F.lit(base)))

    def q_product_summary(spark, d):
        return round_doubles(R.product_summary(PL.feature_table(spark, d, p)))

    def _top(spark, d, pattern, *cols):
        # ranked on the unrounded rates, as the run and the SQL script rank them
        top = R.top_k(R.matching(R.product_summary(PL.feature_table(spark, d, p)), pattern), p.top_k)
        return round_doubles(top.select(*cols))

    def q_top_family(spark, d):
        return _top(spark, d, p.family_pattern, "product_desc", "avg_return_rate")

    def q_top_brand(spark, d):
        return _top(spark, d, p.report_brand_pattern, "product_desc", "avg_return_rate", "avg_ecom_rate")

    def q_preview(spark, d):
        return R.preview(round_doubles(PL.feature_table(spark, d, p)), 10)

    return {name[2:]: fn for name, fn in locals().items() if name.startswith("q_")}


def oracle_queries(p: Params = FIXTURE) -> dict[str, str]:
    feats_round = """SELECT sku_key, round(return_rate, 6) AS return_rate, product_desc, sku_color, sku_size,
       round(sku_cost, 6) AS sku_cost, round(avg_price_product, 6) AS avg_price_product,
       round(quantity, 6) AS quantity, round(ecom_rate, 6) AS ecom_rate, round(receipted_rate, 6) AS receipted_rate
FROM features"""
    summary = """summary AS (
  SELECT product_desc, avg(return_rate) AS avg_return_rate, avg(ecom_rate) AS avg_ecom_rate,
         avg(quantity) AS avg_quantity, sum(quantity) AS tot_quantity
  FROM features GROUP BY product_desc
)"""
    summary_round = """SELECT product_desc, round(avg_return_rate, 6) AS avg_return_rate, round(avg_ecom_rate, 6) AS avg_ecom_rate,
       round(avg_quantity, 6) AS avg_quantity, round(tot_quantity, 6) AS tot_quantity FROM summary"""
    fam, brand = p.family_pattern.replace("'", "''"), p.report_brand_pattern.replace("'", "''")
    null_count_sql = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS null_count FROM features"
        for c in ["sku_key", "return_rate", "product_desc", "sku_color", "sku_size", "sku_cost",
                  "avg_price_product", "quantity", "ecom_rate", "receipted_rate"]
    )
    test = "(SELECT * FROM scored WHERE is_test)"
    sql = {
        "detail_flags": O.line_table_sql(p),
        "active_skus": O.active_skus_sql(p),
        "sku_features": O.with_ctes(p, "", feats_round),
        "sku_features_single_scan": O.with_ctes(p, "", feats_round),
        "sku_features_streaming": O.with_ctes(p, "", feats_round),
        "feature_table_readback": O.with_ctes(p, "", feats_round),
        **{name: O.with_ctes(p, "", feats_round) for name in ("colocated_features", "published_features")},
        "daily_window_features": O.with_ctes(weeks_params(p), "", feats_round),
        "daily_year_features": O.with_ctes(year_params(p), "", feats_round),
        "colocated_active_skus": O.active_skus_sql(p),
        "line_table_sql": O.line_table_sql(p),
        "feature_table_sql": O.with_ctes(p, "", feats_round),
        "report_table_sql": O.with_ctes(p, summary, summary_round),
        "null_mask": O.with_ctes(p, "", "SELECT sku_key, receipted_rate IS NULL OR isnan(receipted_rate) AS receipted_rate_missing FROM features"),
        "schema_info": O.with_ctes(p, "", "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM features"
            for c, t in [("sku_key", "bigint"), ("return_rate", "double"), ("product_desc", "string"),
                         ("sku_color", "string"), ("sku_size", "string"), ("sku_cost", "double"),
                         ("avg_price_product", "double"), ("quantity", "double"), ("ecom_rate", "double"),
                         ("receipted_rate", "double")]
        )),
        "return_label": O.prep_sql(p, "SELECT sku_key, round(return_rate, 6) AS return_rate, label FROM lab"),
        "label_counts": O.prep_sql(p, "SELECT label, count(*) AS n FROM lab GROUP BY label"),
        "encoded_categories": O.prep_sql(p, """
SELECT 'sku_size' AS column_name, sku_size AS category, code FROM size_codes
UNION ALL
SELECT 'sku_color' AS column_name, sku_color AS category, code FROM color_codes"""),
        "log_features": O.with_ctes(p, "", """
SELECT sku_key,
       round(CASE WHEN quantity > 0 THEN ln(quantity) END, 6) AS ln_quantity,
       round(CASE WHEN avg_price_product > 0 THEN ln(avg_price_product) END, 6) AS ln_avg_price_product,
       round(CASE WHEN receipted_rate > 0 THEN ln(receipted_rate) END, 6) AS ln_receipted_rate
FROM features"""),
        "family_flag": O.with_ctes(p, "", f"""
SELECT sku_key, product_desc, CAST(COALESCE(regexp_matches(product_desc, '{p.family_pattern.replace("'", "''")}', 'i'), false) AS INTEGER) AS footwear
FROM features"""),
        "brand_flag": O.with_ctes(p, "", f"""
SELECT sku_key, product_desc, CAST(COALESCE(regexp_matches(product_desc, '{p.brand_pattern.replace("'", "''")}', 'i'), false) AS INTEGER) AS brand
FROM features"""),
        **{name: O.prep_sql(p, f"""
SELECT sku_key, label, round(receipted_rate, 6) AS receipted_rate, sku_color, sku_size,
       round(avg_price_product, 6) AS avg_price_product, round(quantity, 6) AS quantity,
       round(ecom_rate, 6) AS ecom_rate{extra}
FROM logged""") for name, extra in (("predictor_set", ", footwear"), ("predictor_set_all", ""), ("predictor_set_brand", ", brand"))},
        "midpoint_quartiles": O.midpoint_quartiles_sql(p, QUARTILE_COLUMNS),
        "iqr_filtered": O.prep_sql(p, """
SELECT sku_key, label, round(ecom_rate, 6) AS ecom_rate, round(quantity, 6) AS quantity,
       round(avg_price_product, 6) AS avg_price_product
FROM filtered"""),
        "imputed": O.prep_sql(p, "SELECT sku_key, round(receipted_rate, 6) AS receipted_rate FROM cleaned"),
        "zscores": O.prep_sql(p, "SELECT sku_key, " + ", ".join(
            f"round(CASE WHEN (SELECT stddev_pop({c}) FROM cleaned) > 0 THEN "
            f"abs(({c} - (SELECT avg({c}) FROM cleaned)) / (SELECT stddev_pop({c}) FROM cleaned)) END, 6) AS z_{c}"
            for c in ["quantity", "receipted_rate", "avg_price_product", "ecom_rate"]
        ) + " FROM cleaned"),
        "null_counts": O.with_ctes(p, "", null_count_sql),
        "null_columns": O.with_ctes(p, "", "SELECT sku_key, round(receipted_rate, 6) AS receipted_rate FROM features"),
        "describe": O.describe_sql(p, DESCRIBE_COLUMNS),
        "correlation": O.correlation_sql(p, predictors("All")),
        "box_stats": O.box_stats_sql(p, predictors("All")),
        "holdout_split": O.with_ctes(p, "", f"SELECT sku_key, {O.is_test_sql(p)} AS is_test FROM features"),
        "fold_assignment": O.with_ctes(p, "", f"SELECT sku_key, {O.fold_sql(p)} AS fold FROM features"),
        "fold_summary": O.prep_sql(p, f"""
SELECT 'all' AS dataset, round(avg(a), 6) AS mean, round(stddev_pop(a), 6) AS std, round(min(a), 6) AS min, round(max(a), 6) AS max,
       count(*) AS folds
FROM (SELECT fold, avg(CAST(label = prediction AS DOUBLE)) AS a FROM (SELECT *, {O.fold_sql(p)} AS fold FROM scored) f GROUP BY fold) g"""),
        "fixed_prediction_head": O.prep_sql(p, f"""
SELECT sku_key, label, round(score, 6) AS score, prediction FROM {test} t ORDER BY sku_key LIMIT 50"""),
        **O.explanation_sql(p, FIXED_WEIGHTS, FIXED_INTERCEPT, EX.EXPLAINED_ROWS),
        "category_order": O.category_order_sql(p, list(P.ENCODED_COLUMNS)),
        "accuracy": O.prep_sql(p, """
SELECT 'train' AS dataset, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy, count(*) AS n FROM scored WHERE NOT is_test
UNION ALL
SELECT 'test', round(avg(CAST(label = prediction AS DOUBLE)), 6), count(*) FROM scored WHERE is_test
UNION ALL
SELECT 'all', round(avg(CAST(label = prediction AS DOUBLE)), 6), count(*) FROM scored"""),
        "balanced_accuracy": O.prep_sql(p, f"""
SELECT round((sum(CAST(label = 1 AND prediction = 1 AS DOUBLE)) / sum(CAST(label = 1 AS DOUBLE))
            + sum(CAST(label = 0 AND prediction = 0 AS DOUBLE)) / sum(CAST(label = 0 AS DOUBLE))) / 2, 6) AS balanced_accuracy
FROM {test} t"""),
        "confusion": O.prep_sql(p, f"""
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1
FROM {test} t GROUP BY label"""),
        "class_report": O.prep_sql(p, f"""
SELECT class_name, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
  WITH c AS (
    SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
           count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
    FROM {test} t),
  m AS (
    SELECT coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS p1, coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS r1,
           coalesce(tn / nullif(CAST(tn + fn AS DOUBLE), 0), 0) AS p0, coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0) AS r0,
           tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n,
           coalesce((tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0), 0) AS acc
    FROM c),
  mf AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1_1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f1_0,
                coalesce(s0 / nullif(CAST(n AS DOUBLE), 0), 0) AS w0, coalesce(s1 / nullif(CAST(n AS DOUBLE), 0), 0) AS w1 FROM m)
  SELECT '0' AS class_name, p0 AS precision, r0 AS recall, f1_0 AS f1, CAST(s0 AS BIGINT) AS support FROM mf
  UNION ALL SELECT '1', p1, r1, f1_1, CAST(s1 AS BIGINT) FROM mf
  UNION ALL SELECT 'accuracy', NULL, NULL, acc, CAST(n AS BIGINT) FROM mf
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, CAST(n AS BIGINT) FROM mf
  UNION ALL SELECT 'weighted avg', w0 * p0 + w1 * p1, w0 * r0 + w1 * r1, w0 * f1_0 + w1 * f1_1, CAST(n AS BIGINT) FROM mf
) r"""),
        "roc_points": O.prep_sql(p, f"""
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT round(threshold, 6) AS threshold,
       round(sum(fp) OVER (ORDER BY threshold DESC NULLS LAST ROWS UNBOUNDED PRECEDING) / CAST(nn AS DOUBLE), 6) AS fpr,
       round(sum(tp) OVER (ORDER BY threshold DESC NULLS LAST ROWS UNBOUNDED PRECEDING) / CAST(pp AS DOUBLE), 6) AS tpr
FROM (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label <> 1) AS fp
      FROM {test} t GROUP BY score) per,
     (SELECT count(*) FILTER (WHERE label = 1) AS pp, count(*) FILTER (WHERE label <> 1) AS nn FROM {test} t2) tot"""),
        "roc_corners": O.prep_sql(p, f"""
SELECT CAST(NULL AS DOUBLE) AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT round(threshold, 6) AS threshold, round(cfp / CAST(nn AS DOUBLE), 6) AS fpr, round(ctp / CAST(pp AS DOUBLE), 6) AS tpr
FROM (SELECT threshold, sum(fp) OVER falling AS cfp, sum(tp) OVER falling AS ctp, sum(fp) OVER () AS nn, sum(tp) OVER () AS pp,
             row_number() OVER falling AS place, tp, fp, lead(tp) OVER falling AS next_tp, lead(fp) OVER falling AS next_fp
      FROM (SELECT score AS threshold, count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label <> 1) AS fp
            FROM {test} t GROUP BY score) per
      WINDOW falling AS (ORDER BY threshold DESC NULLS LAST)) steps
WHERE place = 1 OR next_tp IS NULL OR tp <> next_tp OR fp <> next_fp"""),
        "roc_auc": O.prep_sql(p, f"""
SELECT round((sum(place) FILTER (WHERE label = 1) - n_pos * (n_pos + 1) / 2) / (n_pos * CAST(n_neg AS DOUBLE)), 6) AS roc_auc, n_pos, n_neg
FROM (SELECT label, avg(place) OVER (PARTITION BY score) AS place,
             count(*) FILTER (WHERE label = 1) OVER () AS n_pos, count(*) FILTER (WHERE label <> 1) OVER () AS n_neg
      FROM (SELECT label, score, row_number() OVER (ORDER BY score NULLS FIRST) AS place FROM {test} t) placed) shared
GROUP BY n_pos, n_neg"""),
        "product_summary": O.with_ctes(p, summary, summary_round),
        **{f"top_family{x}": O.with_ctes(p, summary, f"""
SELECT product_desc, round(avg_return_rate, 6) AS avg_return_rate FROM summary
WHERE COALESCE(regexp_matches(product_desc, '{fam}', 'i'), false)
ORDER BY summary.avg_return_rate DESC NULLS LAST, product_desc LIMIT {p.top_k}""") for x in ("", "_sql")},
        **{f"top_brand{x}": O.with_ctes(p, summary, f"""
SELECT product_desc, round(avg_return_rate, 6) AS avg_return_rate, round(avg_ecom_rate, 6) AS avg_ecom_rate FROM summary
WHERE COALESCE(regexp_matches(product_desc, '{brand}', 'i'), false)
ORDER BY summary.avg_return_rate DESC NULLS LAST, product_desc LIMIT {p.top_k}""") for x in ("", "_sql")},
        "preview": O.with_ctes(p, "", feats_round + " ORDER BY sku_key LIMIT 10"),
    }
    return sql
