"""Model and explanation queries of fitted models (no SQL twin: the driver records a rows-only check).

All queries of a session, data folder and parameter set share one ``Study``, so each model is fitted
once however many queries read it; it is made anew when the input files change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.operators import metrics as M
from returnsight.plans import explain as EX
from returnsight.plans import pipeline as PL
from returnsight.plans.evaluate import Study
from returnsight.sources import as_source

KINDS = ("GBT", "RF", "LR")


def study(spark: SparkSession, sf_dir: str, p: Params) -> Study:
    return PL.memo(spark, as_source(sf_dir), ("study", p), lambda: Study(spark, sf_dir, p))


def model_queries(p: Params) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def of(make: Callable[[Study], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, d: make(study(spark, d, p))

    def with_base(kind: str, explained=Study.shap):
        def make(s: Study) -> DataFrame:
            long, base = explained(s, kind)
            return long.withColumn("base_value", F.lit(base))

        return make

    qs = {
        "cv_summary": of(lambda s: s.cv("LR")),
        "prediction_head": of(lambda s: s.head("GBT")),
        "gbt_eval_history": of(lambda s: s.eval_history("GBT")),
        "gbt_importance": of(lambda s: s.importance("GBT")),
        "rf_importance": of(lambda s: s.importance("RF").orderBy(F.desc("importance"))),
        "gbt_cv_summary": of(lambda s: s.cv("GBT")),
        "rf_cv_summary": of(lambda s: s.cv("RF")),
        "rf_prediction_head": of(lambda s: s.head("RF")),
        "lr_prediction_head": of(lambda s: s.head("LR")),
        "shap_tree": of(with_base("GBT")),
        "shap_forest": of(with_base("RF")),
        "shap_linear": of(with_base("LR")),
        "shap_tree_background": of(with_base("GBT", Study.background_shap)),
        "shap_global": of(lambda s: EX.global_importance(s.shap("GBT")[0])),
        "shap_dependence": of(lambda s: EX.for_class(s.shap("GBT")[0], 0)),
        "shap_one_row": of(lambda s: s.shap_rows("GBT")),
    }
    # whichever model is fitted is evaluated the same way
    for kind in KINDS:
        pre = kind.lower()
        qs[f"{pre}_predictions"] = of(lambda s, k=kind: s.predictions(k))
        qs[f"{pre}_scores"] = of(lambda s, k=kind: s.scores(k))
        qs[f"{pre}_confusion"] = of(lambda s, k=kind: M.confusion(s.predictions(k)))
        qs[f"{pre}_class_report"] = of(lambda s, k=kind: M.class_report(s.predictions(k)))
        qs[f"{pre}_roc"] = of(lambda s, k=kind: M.roc_points(s.predictions(k), score="probability"))
    return qs
