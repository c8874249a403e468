"""End-to-end stages.

``feature_table`` is the reference's materialised CTAS: computed once per session, data folder
and parameter set with the aggregate-before-join plan and checkpointed to the shared folder, so
every later step (median, dictionaries, quartiles, means, models) reads one row per SKU instead
of re-running the line-level scan and join. The prepared frames derived from it are memoised the
same way. ``prepared`` applies the preparation chain in the reference's effective order.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnsight.config import Params, predictors
from returnsight.operators import prepare as P
from returnsight.operators.features import sku_features_eager
from returnsight.plans.daily import features_from_daily
from returnsight.session import files_version, listed_version, materialise, session_key
from returnsight.sources import Source, as_source

_TABLES: dict[tuple, tuple[str, object]] = {}


#: Versions looked up by the memoised call in progress, which those inside it share.
_CURRENT: ContextVar[dict[Source, str] | None] = ContextVar("versions", default=None)


def _version(spark: SparkSession, source: Source) -> str:
    paths = source.paths()
    if paths is None:
        return files_version(source.lines(spark), source.dimension(spark))
    return listed_version(spark, paths)


def memo(spark: SparkSession, source: Source, key: tuple, build: Callable[[], object]):
    """``build()``, kept per session, source and key for as long as the source's files stay the same;
    once they change, what was built from the old ones is dropped. The files are looked at once for
    the outermost call and those that it makes while building."""
    k = (session_key(spark), source, *key)
    seen = _CURRENT.get()
    token = _CURRENT.set({}) if seen is None else None
    try:
        versions = _CURRENT.get()
        if source not in versions:
            versions[source] = _version(spark, source)
        if k not in _TABLES or _TABLES[k][0] != versions[source]:
            _TABLES.pop(k, None)
            _TABLES[k] = (versions[source], build())
        return _TABLES[k][1]
    finally:
        if token is not None:
            _CURRENT.reset(token)


def forget(spark: SparkSession | None = None) -> None:
    """Drop memoised tables and models (all, or one application's)."""
    for k in list(_TABLES):
        if spark is None or k[0] == session_key(spark):
            del _TABLES[k]


def feature_table(spark: SparkSession, sf_dir: str | Source, params: Params, *, persist: bool = True) -> DataFrame:
    """``sf_dir`` is a test-table folder or a ``Source`` (production line and SKU tables)."""
    source = as_source(sf_dir)

    def build() -> DataFrame:
        if source.daily is not None:
            return features_from_daily(spark, source.daily, source.dimension(spark), params)
        return sku_features_eager(*source.load(spark), params)

    if not persist:
        return build()
    return memo(spark, source, ("features", params), lambda: materialise(build()))


def labelled(spark: SparkSession, sf_dir: str | Source, params: Params) -> DataFrame:
    return memo(spark, as_source(sf_dir), ("labelled", params), lambda: P.return_label(feature_table(spark, sf_dir, params)))


def encoded(spark: SparkSession, sf_dir: str | Source, params: Params) -> DataFrame:
    """Label, encoded categories and text flags (the frame the exploration step looks at)."""
    return memo(
        spark,
        as_source(sf_dir),
        ("encoded", params),
        lambda: materialise(P.text_flags(P.label_encode(labelled(spark, sf_dir, params)), params)),
    )


def logged(spark: SparkSession, sf_dir: str | Source, params: Params) -> DataFrame:
    return P.log_columns(encoded(spark, sf_dir, params), params.log_columns, in_place=True)


@dataclass
class Prepared:
    before_cleaning: DataFrame  # labelled, encoded, flagged, logged
    cleaned: DataFrame  # after IQR removal and mean imputation
    predictors: list[str]
    categories: list[str]  # predictors that are encoded categories


def prepared(spark: SparkSession, sf_dir: str | Source, params: Params) -> Prepared:
    def build() -> Prepared:
        before = logged(spark, sf_dir, params)
        no_outliers = P.iqr_filter(before, params.iqr_columns, params.iqr_factor)
        cleaned = materialise(P.impute_mean(no_outliers, params.impute_columns))
        cols = predictors(params.predictor_set)
        return Prepared(before, cleaned, cols, [c for c in cols if c in P.ENCODED_COLUMNS])

    return memo(spark, as_source(sf_dir), ("prepared", params), build)


def model_frame(prep: Prepared, params: Params) -> DataFrame:
    """``sku_key``, ``label`` and the predictor columns as doubles."""
    cols = prep.predictors
    return prep.cleaned.select("sku_key", F.col("label").cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in cols])
