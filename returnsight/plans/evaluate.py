"""Fitting, scoring and explaining the models of one data set and parameter set.

One ``Study`` holds what its outputs share: the split model frame, each fitted model, its scored
rows and its Shapley values, each made once and written to the shared checkpoint folder. The
registered queries and the end-to-end run both read from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params
from returnsight.operators import metrics as M
from returnsight.plans import explain as EX
from returnsight.plans import models as MD
from returnsight.plans import pipeline as PL
from returnsight.session import materialise
from returnsight.sources import Source


class Study:
    def __init__(self, spark: SparkSession, source: str | Source, params: Params):
        self.spark, self.source, self.params = spark, source, params
        self._made: dict[tuple, object] = {}

    def _once(self, key: tuple, build):
        if key not in self._made:
            self._made[key] = build()
        return self._made[key]

    @cached_property
    def prepared(self) -> PL.Prepared:
        return PL.prepared(self.spark, self.source, self.params)

    @property
    def cols(self) -> list[str]:
        return self.prepared.predictors

    @cached_property
    def frame(self) -> DataFrame:
        """Key, label, predictors and ``is_test``, spread over the cluster's cores for the Python-side
        work of the explanations (a small frame arrives in one partition)."""
        split = MD.split(PL.model_frame(self.prepared, self.params), self.params)
        return materialise(split.repartition(self.spark.sparkContext.defaultParallelism, "sku_key"))

    @property
    def train(self) -> DataFrame:
        return self.frame.filter(~F.col("is_test")).drop("is_test")

    @property
    def test(self) -> DataFrame:
        return self.frame.filter(F.col("is_test")).drop("is_test")

    def categories(self, kind: str) -> list[str]:
        return self.prepared.categories if kind == "GBT" else []

    def fitted(self, kind: str) -> MD.Fitted:
        return self._once(("model", kind), lambda: MD.fit(kind, self.train, self.cols, self.params, categories=self.categories(kind)))

    def scored(self, kind: str) -> DataFrame:
        """Every row scored once, with ``is_test``."""
        return self._once(("scored", kind), lambda: materialise(MD.predict(self.fitted(kind), self.frame, extra=("is_test",))))

    def predictions(self, kind: str) -> DataFrame:
        return self.scored(kind).filter("is_test").drop("is_test")

    def head(self, kind: str, n: int = 50) -> DataFrame:
        return self.predictions(kind).orderBy("sku_key").limit(n)

    def scores(self, kind: str) -> DataFrame:
        """Accuracy on train, test and all rows, balanced accuracy of the test predictions and ROC AUC
        of their probabilities."""
        rows = self.scored(kind)
        auc = M.roc_auc(rows.filter("is_test"), score="probability").first()["roc_auc"]
        return M.score_table(rows, auc)

    def importance(self, kind: str) -> DataFrame:
        m = self.fitted(kind)
        if kind == "LR":
            rows = [(c, float(w)) for c, w in zip(m.cols, m.model.coefficients.toArray(), strict=True)]
            return self.spark.createDataFrame(rows, "feature string, coefficient double")
        gain = MD.importances(m)
        return MD.split_counts(m).join(gain.withColumnRenamed("importance", "gain_importance"), "feature") if kind == "GBT" else gain

    def eval_history(self, kind: str = "GBT") -> DataFrame:
        return MD.eval_history(self.fitted(kind), self.train, self.test)

    def cv(self, kind: str) -> DataFrame:
        frames = {"train": self.train, "test": self.test, "all": self.frame.drop("is_test")}
        scores = MD.cv_scores(kind, frames, self.cols, self.params, categories=self.categories(kind))
        return MD.fold_summary(scores).withColumn("model", F.lit(kind))

    def _explained(self, kind: str, rows: DataFrame) -> tuple[DataFrame, float]:
        if kind == "LR":
            return EX.linear_shap(rows, self.fitted(kind), self.train)
        return EX.tree_shap(rows, self.fitted(kind))

    def shap(self, kind: str) -> tuple[DataFrame, float]:
        """Shapley values of every row, written once."""

        def build() -> tuple[DataFrame, float]:
            long, base = self._explained(kind, self.frame)
            return materialise(long), base

        return self._once(("shap", kind), build)

    def background_shap(self, kind: str = "GBT") -> tuple[DataFrame, float]:
        """Interventional values of every row against all training rows, written once."""

        def build() -> tuple[DataFrame, float]:
            long, base = EX.background_shap(self.frame, self.fitted(kind), self.train)
            return materialise(long), base

        return self._once(("background_shap", kind), build)

    def shap_rows(self, kind: str) -> DataFrame:
        """The picked rows' explanations; only these rows are explained."""
        long, base = self._explained(kind, EX.picked_rows(self.frame))
        return EX.one_row(long, base)
