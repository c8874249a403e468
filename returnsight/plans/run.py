"""The whole analysis in one call, as the reference runs it top to bottom: feature build,
label / encode / logs, predictor set, cleaning, exploration, one model (fit, evaluate,
cross-validate, explain) and the product reports. Every output is a DataFrame written to
``out_dir/<name>`` (parquet, overwritten on rerun); nothing but scalars and the model passes
through the driver."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import ZSCORE_COLUMNS, Params, predictors
from returnsight.operators import explore as X
from returnsight.operators import metrics as M
from returnsight.operators import prepare as P
from returnsight.operators import report as R
from returnsight.plans import explain as EX
from returnsight.plans import pipeline as PL
from returnsight.plans.evaluate import Study
from returnsight.session import size_shuffles
from returnsight.sources import Source, as_source, write_table


def analysis(
    spark: SparkSession, source: str | Source, params: Params, model: str = "GBT", *, cross_validate: bool = True
) -> dict[str, Callable[[], DataFrame]]:
    """Named output tables, each built lazily on request (in this order when all are written)."""
    model = model.upper()
    cols = predictors(params.predictor_set)
    out: dict[str, Callable[[], DataFrame]] = {}
    study = Study(spark, source, params)

    def features() -> DataFrame:
        return PL.feature_table(spark, source, params)

    def summary() -> DataFrame:
        return R.product_summary(features())

    out["features"] = features
    out["null_counts"] = lambda: X.null_counts(features())
    out["describe"] = lambda: X.describe(PL.encoded(spark, source, params))
    out["correlation"] = lambda: X.correlation(PL.encoded(spark, source, params), cols)
    out["box_stats"] = lambda: X.box_stats(study.prepared.before_cleaning, cols)
    out["prepared"] = lambda: study.prepared.cleaned
    out["zscores"] = lambda: P.zscores(study.prepared.cleaned, list(ZSCORE_COLUMNS))
    out["predictions"] = lambda: study.predictions(model)
    out["scores"] = lambda: study.scores(model)
    out["confusion"] = lambda: M.confusion(study.predictions(model))
    out["class_report"] = lambda: M.class_report(study.predictions(model))
    out["roc"] = lambda: M.roc_points(study.predictions(model), score="probability")
    out["roc_corners"] = lambda: M.roc_points(study.predictions(model), score="probability", drop_intermediate=True)
    out["importance"] = lambda: study.importance(model)
    if model == "GBT":
        out["eval_history"] = lambda: study.eval_history(model)
    if cross_validate:
        out["cv_summary"] = lambda: study.cv(model)
    out["shap_values"] = lambda: study.shap(model)[0].withColumn("base_value", F.lit(study.shap(model)[1]))
    out["shap_global"] = lambda: EX.global_importance(study.shap(model)[0])
    if model != "LR":
        out["shap_background"] = lambda: study.background_shap(model)[0].withColumn("base_value", F.lit(study.background_shap(model)[1]))
    out["shap_one_row"] = lambda: study.shap_rows(model)
    out["product_summary"] = summary
    out["top_family"] = lambda: R.top_k(R.matching(summary(), params.family_pattern), params.top_k)
    out["top_brand"] = lambda: R.top_k(R.matching(summary(), params.report_brand_pattern), params.top_k)
    return out


def run(
    spark: SparkSession,
    source: str | Source,
    params: Params,
    out_dir: str,
    model: str = "GBT",
    *,
    cross_validate: bool = True,
    only: list[str] | None = None,
) -> list[str]:
    """Write every output table (or those in ``only``) under ``out_dir``; returns the names.

    Shuffle partitions are sized once from the bytes the line table scan reads."""
    size_shuffles(spark, as_source(source).lines(spark))
    tables = analysis(spark, source, params, model, cross_validate=cross_validate)
    written = []
    for name, build in tables.items():
        if only and name not in only:
            continue
        write_table(build(), os.path.join(out_dir, name))
        written.append(name)
    return written
