"""Quality by hierarchical empirical Bayes.

A logistic classifier on surface measures of a text gives evidence for each document. Sites add to
it: the expected number of good documents is summed per host and per path, and each group's share is
shrunk, a path's towards its host's and a host's towards the global one, as beta posteriors whose
strengths come from how much the groups really differ. A sparse site thus says little, a large bad
one much. A document's own evidence is left out of its site's share before the two are combined.

Groups are sums (partial sums per task first), so a site with a third of all documents is no
hot spot; only the strengths, two numbers, reach the driver."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from returnsight.llm import logistic
from returnsight.llm.common import fit_sample, held_out, ready, staged
from returnsight.operators.features import broadcast_if_small

#: At most so many labelled rows are used for fitting.
FIT_ROWS = 20_000
THRESHOLD = 0.5
MEASURES = 17


def measures(text: str) -> list[float]:
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    n = max(1, len(data))
    words, lines = text.split(), [x for x in text.split("\n") if x]
    share = counts / n
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    seen = share[share > 0]
    return [
        np.log1p(len(data)),
        np.log1p(len(words)),
        counts[65:91].sum() / max(1, letters),
        share[48:58].sum(),
        share[128:].sum(),
        share[[33, 63]].sum(),
        share[[35, 36, 37, 38, 42, 64, 94, 126]].sum(),
        share[[124, 60, 62, 123, 125, 91, 93, 92, 95, 61, 43, 47]].sum(),
        share[[44, 46, 58, 59]].sum(),
        share[32],
        share[10],
        letters / n,
        len(set(words)) / max(1, len(words)),
        len(set(lines)) / max(1, len(lines)),
        len(text) / max(1, len(words) + len(text.split("\n"))),
        share.max(),
        -(seen * np.log(seen)).sum() if len(seen) else 0.0,
    ]


class Model(NamedTuple):
    regression: logistic.Logistic

    def probability(self, texts: list[str]) -> np.ndarray:
        x = np.array([measures(t) for t in texts], float).reshape(-1, MEASURES)
        return 1 / (1 + np.exp(-np.clip(self.regression.logit(x), -12, 12)))


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """Classifier of ``labels.quality`` on at most ``bound`` labelled rows outside the held-out third."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [[float(v) for v in measures(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["x", "y"])

    rows = fit_sample(ready(docs), labels, "quality", bound).mapInArrow(measure, "x array<double>, y int").collect()
    sample = np.array([[*r["x"], r["y"]] for r in rows], float).reshape(-1, MEASURES + 1)
    sample = sample[np.lexsort(sample.T)]  # the same model whatever the partitions
    return Model(logistic.fit(sample[:, :-1], sample[:, -1]))


def evidence(text: Column, model: Model) -> Column:
    """Classifier's probability that a text (null: empty) is good."""

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.probability([t or "" for t in texts]), dtype=float)

    return scored(text.cast("string"))


class Prior(NamedTuple):
    share: float  # global
    host_strength: float
    path_strength: float


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength (in documents) from the spread of group shares around ``mean``: the variance
    beyond what groups of their sizes show by chance, in the units of a beta distribution."""
    p = F.col("good") / F.col("n")
    chance = mean * (1 - mean)
    r = groups.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (p - mean) ** 2).alias("spread"), F.sum(F.col("n") * chance).alias("within")).first()
    if not r["n"] or not r["within"]:
        return 1.0
    within = r["within"] / r["n"]
    between = (r["spread"] - r["k"] * within) / r["n"]
    return float(np.clip(within / between - 1, 1.0, 1e6)) if between > 0 else 1e6


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """Posteriors per (host, path) of rows (host, path, p): host, path, n, good (sums of the path),
    host_n, host_good and the global prior."""
    paths = staged(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    share = (total["good"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    host_strength = _strength(hosts, F.lit(share))
    of_host = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    sites = staged(paths.join(of_host, "host"), "sites")
    host_mean = (F.lit(host_strength * share) + F.col("host_good")) / (host_strength + F.col("host_n"))
    prior = Prior(share, host_strength, _strength(sites.withColumn("mean", host_mean), F.col("mean")))
    return sites, prior


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def with_scores(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """``docs`` as struct ``row``, with evidence, host_posterior, path_posterior and score."""
    # a null site is a site of its own, apart from the empty name
    key = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")).alias(n) for n, c in (("host", host), ("path", path))]
    rows = ready(docs).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *key, evidence(F.col("text"), model).alias("p"))
    sites, prior = site_posteriors(rows.select("host", "path", "p"))
    # broadcast within measured bounds, so that texts are not shuffled by site
    sites = broadcast_if_small(sites.withColumnsRenamed({"host": "site_host", "path": "site_path"}))
    out = rows.join(sites, (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path")))
    p = F.col("p")
    host_mean = (F.lit(prior.host_strength * prior.share) + F.col("host_good") - p) / (prior.host_strength + F.col("host_n") - 1)
    path_mean = (prior.path_strength * host_mean + F.col("good") - p) / (prior.path_strength + F.col("n") - 1)
    within = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    total = _logit(within(p)) + _logit(within(path_mean)) - _logit(within(F.lit(prior.share)))
    return out.select("row", p.alias("evidence"), host_mean.alias("host_posterior"), path_mean.alias("path_posterior"), (1 / (1 + F.exp(-total))).alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = THRESHOLD, bound: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, evidence, host_posterior, path_posterior, score and predicted (1: keep) of
    every row of ``docs``; ``host`` and ``path`` name its columns for the site and its part.

    Null texts count as empty; a null host or path is a group of its own; null and repeated ids are
    kept; without labels of both kinds all evidence is the smoothed share of good labels; an empty
    table gives no rows; other columns are ignored."""
    own = docs.select("doc_id", "text", F.col(host).alias("of_host"), F.col(path).alias("of_path"))
    out = with_scores(own, fit(docs, labels, bound), F.col("of_host"), F.col("of_path"))
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_only(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score at least ``threshold``, all their columns as they are."""
    return with_scores(docs, model, F.col(host), F.col(path)).where(F.col("score") >= threshold).select("row.*")
