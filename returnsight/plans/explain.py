"""Shapley-value explanations of fitted models, computed over every row as Spark jobs.

Trees (GBT, RF), by either of the tree explainer's definitions of a coalition's value v(S), the
expected output with the features in S fixed at the row's values:

* path-dependent (``tree_shap``): the other features follow the training distribution recorded in the
  node covers, so a leaf counts as the product, over the features on its path, of 1 or 0 (the row
  follows the path or not) for those in S and of the path's share of the covers for the rest. Summed by
  the size of S these products are the coefficients of prod_j (z_j + o_j y), built up by one factor at
  a time; a feature's Shapley value needs the product without its own factor, which is divided out
  again. That costs the square of the path's length, whatever the number of predictors.
* interventional (``background_shap``): the other features are those of a background row, averaged
  over the whole background. Against one background row, a leaf is a game in which the row's features
  must be in S and the background row's must not; its Shapley values are two quotients of factorials
  in the sizes of these sets. Background rows that meet the same conditions of a path play the same
  game, so one pass counts them by the conditions met, and a row's values are looked up by its own.

The node table is read with Spark from the model's own persistence output; it is bounded by the
model's size (trees x 2^(depth+1) nodes), not by the data, and ships to the tasks with the function.
Each partition evaluates its rows with numpy, so the work is split over the cluster like the rows.

Boosted trees are explained in log-odds (what the classifier thresholds); forests in class-1
probability (the mean of the trees' leaf class shares).

Linear model: closed form ``phi_i = w_i (x_i - mean_i)`` with the means of the training data,
as column expressions; the base value is ``w . mean + b`` in log-odds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returnsight.functions import ship_by_value
from returnsight.plans.models import Fitted, fill_missing, node_table

ship_by_value(__name__)


@dataclass
class LeafPath:
    value: float
    # (feature index, threshold, goes left, cover share)
    steps: list[tuple[int, float, bool, float]]


@dataclass
class TreeTables:
    weights: list[float]
    leaves: list[list[LeafPath]]  # per tree
    scale: float  # output multiplier (2 for boosted trees: margin -> log-odds)
    n_features: int


def tree_tables(fitted: Fitted) -> TreeTables:
    """The fitted trees' nodes as leaf paths."""
    kind, model, nodes = fitted.kind, fitted.model, node_table(fitted)
    by_tree: dict[int, dict[int, object]] = {}
    for r in nodes:
        by_tree.setdefault(r["tree"], {})[r["id"]] = r
    n_trees = len(by_tree)
    if kind == "GBT":
        weights, scale = [float(w) for w in model.treeWeights], 2.0
    else:
        weights, scale = [1.0 / n_trees] * n_trees, 1.0

    def leaf_value(r) -> float:
        if kind == "GBT":
            return float(r["prediction"])
        stats = list(r["stats"])
        total = sum(stats)
        return float(stats[1] / total) if total > 0 and len(stats) > 1 else 0.0

    def cover(r) -> float:
        return float(r["count"]) if r["count"] is not None else float(r["stats"][0])

    leaves = []
    for t in sorted(by_tree):
        tbl = by_tree[t]
        root = 0 if 0 in tbl else min(tbl)
        out: list[LeafPath] = []
        stack = [(root, [])]
        while stack:
            nid, steps = stack.pop()
            r = tbl[nid]
            if r["left"] < 0:
                out.append(LeafPath(leaf_value(r), steps))
                continue
            c = cover(r)
            f = int(r["feature"])
            split = list(r["split"])
            if r["ncat"] >= 0:
                raise ValueError("categorical splits are not explained; category columns are ordered numbers here")
            threshold = float(split[0])
            for child, left in ((r["left"], True), (r["right"], False)):
                share = cover(tbl[child]) / c if c > 0 else 0.5
                stack.append((child, steps + [(f, threshold, left, share)]))
        leaves.append(out)
    return TreeTables(weights, leaves, scale, len(fitted.cols))


@dataclass
class Path:
    """A leaf's path by feature: the row follows it if lower < x <= upper for each feature (a missing
    value takes every right turn); ``shares`` are the products of the covers' shares."""

    value: float
    features: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    shares: np.ndarray

    def follows(self, x: np.ndarray) -> np.ndarray:
        own = x[:, self.features]
        return ~(own <= self.lower) & ((own <= self.upper) | np.isposinf(self.upper))


def paths_of(tables: TreeTables) -> list[Path]:
    """All leaves' paths, their values multiplied by the trees' weights and the output's scale."""
    out = []
    for weight, leaves in zip(tables.weights, tables.leaves, strict=True):
        for leaf in leaves:
            features = sorted({f for f, *_ in leaf.steps})
            at = {f: j for j, f in enumerate(features)}
            lower, upper, shares = np.full(len(at), -np.inf), np.full(len(at), np.inf), np.ones(len(at))
            for f, threshold, left, share in leaf.steps:
                if left:
                    upper[at[f]] = min(upper[at[f]], threshold)
                else:
                    lower[at[f]] = max(lower[at[f]], threshold)
                shares[at[f]] *= share
            out.append(Path(weight * leaf.value * tables.scale, np.array(features, int), lower, upper, shares))
    return out


def _extended(follows: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Coefficients, by rising power of y, of prod_j (z_j + o_j y) for every row."""
    n, d = follows.shape
    out = np.zeros((n, d + 1))
    out[:, 0] = 1.0
    for j in range(d):
        out[:, 1 : j + 2] = out[:, 1 : j + 2] * shares[j] + out[:, : j + 1] * follows[:, j : j + 1]
        out[:, 0] *= shares[j]
    return out


def _unwound(product: np.ndarray, follows: np.ndarray, share: float) -> np.ndarray:
    """The product without one factor (z + o y)."""
    d = product.shape[1] - 1
    out = np.zeros((len(product), d))
    if d and share > 0:
        out[:] = product[:, :d] / share  # right where the row does not follow
    rest = np.zeros(len(product))
    for t in range(d - 1, -1, -1):  # where it does: q_t = p_(t+1) - z q_(t+1)
        rest = product[:, t + 1] - share * rest
        out[:, t] = np.where(follows, rest, out[:, t])
    return out


def path_values(x: np.ndarray, paths: Sequence[Path], m: int) -> np.ndarray:
    """Path-dependent Shapley values of every row: n x m."""
    phi = np.zeros((len(x), m))
    for path in paths:
        d = len(path.features)
        if not d or path.value == 0.0:
            continue
        follows = path.follows(x).astype(float)
        product = _extended(follows, path.shares)
        by_size = np.array([math.factorial(t) * math.factorial(d - t - 1) / math.factorial(d) for t in range(d)])
        for j, f in enumerate(path.features):
            others = _unwound(product, follows[:, j] > 0, path.shares[j])
            phi[:, f] += path.value * (follows[:, j] - path.shares[j]) * (others @ by_size)
    return phi


def base_value(paths: Sequence[Path]) -> float:
    return float(sum(path.value * path.shares.prod() for path in paths))


def tree_shap(df: DataFrame, fitted: Fitted, key: str = "sku_key") -> tuple[DataFrame, float]:
    """Long frame ``key, feature, value, phi`` for every row, plus the base value v(empty). Missing
    predictors are explained at the value the model sees, categories at their place in its order;
    ``value`` shows both as they are in the frame."""
    return tables_shap(df, tree_tables(fitted), fitted.cols, fitted.filled, key)


View = Callable[[DataFrame], DataFrame]


def tables_shap(df: DataFrame, tables: TreeTables, cols: Sequence[str], view: View | None = None, key: str = "sku_key") -> tuple[DataFrame, float]:
    paths, m = paths_of(tables), len(cols)
    return _explained(df, list(cols), view, key, lambda x: path_values(x, paths, m)), base_value(paths)


def _seen(df: DataFrame, cols: Sequence[str], view: View | None, *keep: str) -> DataFrame:
    """``keep`` and the columns, as doubles, as the model sees them; values as they are in ``_v<i>``."""
    shown = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols], *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    return view(shown) if view else shown


def _explained(df: DataFrame, cols: list[str], view: View | None, key: str, values: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    shown = [f"_v{i}" for i in range(len(cols))]

    def explain(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            phi = values(pdf[cols].to_numpy(dtype=float))  # n x M
            n = len(pdf)
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), len(cols)),
                "feature": np.tile(np.array(cols, dtype=object), n),
                "value": pd.array(pdf[shown].to_numpy(dtype=float).reshape(-1), dtype="Float64"),
                "phi": phi.reshape(-1),
            })

    schema = f"{key} {dict(df.dtypes)[key]}, feature string, value double, phi double"
    return _seen(df, cols, view, key).select(key, *cols, *shown).mapInPandas(explain, schema)


def _met(paths: Sequence[Path], cols: list[str]):
    """Tasks over background rows: how many meet which of each path's conditions (as bits)."""

    def run(batches):
        counts = [dict() for _ in paths]
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            for own, path in zip(counts, paths, strict=True):
                met, n = np.unique(path.follows(x) @ (1 << np.arange(len(path.features))), return_counts=True)
                for pattern, k in zip(met.tolist(), n.tolist(), strict=True):
                    own[pattern] = own.get(pattern, 0) + k
        rows = [(i, pattern, k) for i, own in enumerate(counts) for pattern, k in own.items()]
        yield pd.DataFrame(rows, columns=["path", "met", "n"]).astype("int64")

    return run


def _games(path: Path, background: dict[int, int]) -> np.ndarray:
    """Shapley values of a path's features for every pattern of conditions that a row may meet,
    against the background's patterns, weighted by their rows: 2^d x d."""
    d = len(path.features)
    bits = (np.arange(2**d)[:, None] >> np.arange(d)[None, :]) & 1
    total, out = sum(background.values()), np.zeros((2**d, d))
    for pattern, n in background.items():
        own, other = bits, bits[pattern][None, :]
        needs, bars = own * (1 - other), (1 - own) * other
        a, b = needs.sum(axis=1), bars.sum(axis=1)
        reachable = ((own + other) > 0).all(axis=1)
        gain = np.array([math.factorial(max(i - 1, 0)) * math.factorial(j) / math.factorial(i + j) for i, j in zip(a, b, strict=True)])
        loss = np.array([math.factorial(i) * math.factorial(max(j - 1, 0)) / math.factorial(i + j) for i, j in zip(a, b, strict=True)])
        out += n / total * reachable[:, None] * (needs * gain[:, None] - bars * loss[:, None])
    return path.value * out


def background_shap(df: DataFrame, fitted: Fitted, background: DataFrame, key: str = "sku_key") -> tuple[DataFrame, float]:
    """As ``tree_shap``, with the other features taken from the rows of ``background``, all of them."""
    return tables_background_shap(df, tree_tables(fitted), fitted.cols, background, fitted.filled, key)


def tables_background_shap(
    df: DataFrame, tables: TreeTables, cols: Sequence[str], background: DataFrame, view: View | None = None, key: str = "sku_key"
) -> tuple[DataFrame, float]:
    cols, m = list(cols), len(cols)
    paths = [path for path in paths_of(tables) if path.value]
    met = _seen(background, cols, view).select(*cols).mapInPandas(_met(paths, cols), "path long, met long, n long")
    counts: list[dict[int, int]] = [{} for _ in paths]
    for r in met.groupBy("path", "met").agg(F.sum("n").alias("n")).collect():  # a row per path and pattern met
        counts[r["path"]][r["met"]] = r["n"]
    if not paths or not counts[0]:
        raise ValueError("the background has no rows")
    games = [_games(path, own) for path, own in zip(paths, counts, strict=True)]
    base = float(sum(path.value * own.get((1 << len(path.features)) - 1, 0) / sum(own.values()) for path, own in zip(paths, counts, strict=True)))

    def values(x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), m))
        for path, game in zip(paths, games, strict=True):
            phi[:, path.features] += game[path.follows(x) @ (1 << np.arange(len(path.features)))]
        return phi

    return _explained(df, cols, view, key, values), base


def _filled(cols: Sequence[str], names: Sequence[str], fill: dict[str, float]):
    return [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(fill.get(c)).cast("double")).alias(n) for c, n in zip(cols, names, strict=True)]


def linear_shap(df: DataFrame, fitted: Fitted, background: DataFrame, key: str = "sku_key") -> tuple[DataFrame, float]:
    """Closed-form values of a linear model in log-odds against the background means."""
    return weights_shap(df, dict(zip(fitted.cols, fitted.model.coefficients.toArray().tolist(), strict=True)), float(fitted.model.intercept), background, fitted.fill, key)


def weights_shap(
    df: DataFrame, weights: dict[str, float], intercept: float, background: DataFrame, fill: dict[str, float] | None = None, key: str = "sku_key"
) -> tuple[DataFrame, float]:
    cols = list(weights)
    means = fill_missing(background, fill or {}).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    base = intercept + sum(w * (means[c] or 0.0) for c, w in weights.items())
    parts = F.array(*[
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
            (F.lit(w) * (seen - F.lit(means[c]).cast("double"))).alias("phi"),
        )
        for (c, w), seen in zip(weights.items(), _filled(cols, cols, fill or {}), strict=True)
    ])
    return df.select(key, F.inline(parts)), base


def global_importance(long: DataFrame) -> DataFrame:
    """Mean |phi| per feature (the bar summary)."""
    return long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))


def for_class(long: DataFrame, cls: int) -> DataFrame:
    """Values for class 0 are the negation of class 1's for a two-class log-odds or probability output."""
    return long if cls == 1 else long.withColumn("phi", -F.col("phi"))


def one_row(long: DataFrame, base: float, key: str = "sku_key") -> DataFrame:
    """Each row's explanation: contributions by decreasing |phi|, with the running total from the base value."""
    order = Window.partitionBy(key).orderBy(F.abs("phi").desc(), "feature")
    return long.select(
        key, "feature", "value", "phi",
        (F.lit(base) + F.sum("phi").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("cumulative"),
        F.row_number().over(order).alias("rank"),
    )


#: The rows, counted from 0 in key order, that the analysis explains one by one.
EXPLAINED_ROWS = (10, 8, 0)


def picked_rows(frame: DataFrame, rows: Sequence[int] = EXPLAINED_ROWS, key: str = "sku_key") -> DataFrame:
    """The rows of ``frame`` at the given places in key order; filtered before any explaining."""
    keys = [r[key] for r in frame.select(key).orderBy(key).limit(max(rows) + 1).collect()]
    return frame.filter(F.col(key).isin([keys[r] for r in rows if r < len(keys)]))
