"""Boosted trees of Spark ML, fitted on the distinct cells of the binned rows.

A tree reads a feature only by its bin (at most ``maxBins``). Rows with the same
bins, label and weight therefore share their margin and gradient in every round,
so a cell and its row count stand for them: sums over rows are sums over cells
times counts, and keeping each row with probability ``subsamplingRate`` keeps a
binomial share of the count. One aggregation, combined map-side, makes the cells;
all rounds run over them in one place, without a job per tree level.

The rules are those of ``GBTClassifier``: logistic loss on labels -1 and +1, the
first tree on the labels with weight 1, the others on the gradients with weight
``stepSize``, splits by the gain in variance, features drawn per node. Bins come
from all rows (every value where there are few, else quantiles of a sketch).
Rows that do not fall into few cells go to ``GBTClassifier`` itself.

Scoring walks the trees as flat arrays, all rows of a batch at once, and scores a
combination of bins once per Python worker; the result is that of the model's
``transform``.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtriage.sources.workspace import durable, exists, new_folder

#: More cells than this are not collected. So many of six features took 1.9 s a round of depth 8 and 460 MB on the driver.
MAX_CELLS = 2_000_000


class CellGBTClassifier(Estimator):
    """Fits what ``booster`` describes and returns the same kind of model."""

    def __init__(self, booster: GBTClassifier):
        super().__init__()
        self.booster = booster

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        found = cells(dataset, self.booster)
        if found is None:
            return self.booster.fit(dataset)
        x, y, weight, count, splits = found
        trees = boost(x, y, weight, count, splits, self.booster)
        return to_model(dataset.sparkSession, trees, splits, self.booster)


# -- cells -------------------------------------------------------------------

def split_points(rows: DataFrame, columns: list[str], bins: int) -> list[list[float]]:
    """Thresholds per column: between all values where there are at most ``bins``, else quantiles."""
    shares = [k / bins for k in range(1, bins)]
    distinct = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if distinct[c] <= 2 * bins]
    many = [c for c in columns if distinct[c] > bins // 2]
    found = rows.agg(
        *[F.array_sort(F.collect_set(c)).alias(f"v{c}") for c in few],
        # Wrong by at most a hundredth of a bin.
        *[F.percentile_approx(c, shares, 100 * bins).alias(f"q{c}") for c in many],
    ).first()
    points = {c: sorted(set(found[f"q{c}"] or [])) for c in many}
    for c in few:
        values = found[f"v{c}"]
        if c not in points or len(values) <= bins:
            points[c] = [_between(a, b) for a, b in zip(values, values[1:])]
    return [points[c] for c in columns]


def _between(a: float, b: float) -> float:
    middle = a + (b - a) / 2
    return middle if a < middle < b else a


def _bin(x: Column, points: list[float]) -> Column:
    """Thresholds below x, found by halving."""
    if not points:
        return F.lit(0)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(x <= points[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(points))


def cells(dataset: DataFrame, booster: GBTClassifier):
    """Bins (feature by cell), labels -1 and +1, weights and row counts of the cells, and the
    thresholds per feature; None if there are more than ``MAX_CELLS``."""
    label, weight = booster.getLabelCol(), booster.getWeightCol()
    width = dataset.schema[booster.getFeaturesCol()].metadata["ml_attr"]["num_attrs"]
    names = [f"_x{i}" for i in range(width)]
    arrays = dataset.select(vector_to_array(booster.getFeaturesCol()).alias("_x"), label, weight)
    rows = arrays.select(*[F.col("_x")[i].alias(n) for i, n in enumerate(names)], label, weight).persist()
    try:
        splits = split_points(rows, names, booster.getMaxBins())
        binned = rows.select(*[_bin(F.col(n), p).cast("short").alias(n) for n, p in zip(names, splits)], label, weight)
        grouped = durable(binned.groupBy(*names, label, weight).agg(F.count("*").alias("_n")), "cells")
    finally:
        rows.unpersist()
    size = grouped.count()
    if size == 0:
        raise ValueError("no rows to fit a detector on")
    if size > MAX_CELLS:
        return None
    table = grouped.toArrow()  # at most MAX_CELLS rows
    y = table[label].to_numpy()
    if not np.isin(y, (0.0, 1.0)).all():
        raise ValueError(f"{label} has values other than 0 and 1")
    w = table[weight].to_numpy()
    if not (w >= 0).all():
        raise ValueError(f"{weight} has missing or negative values")
    x = np.stack([table[n].to_numpy() for n in names]).astype(np.uint8 if booster.getMaxBins() <= 256 else np.int32)
    order = np.lexsort((w, y, *x))  # the same cells give the same trees however they arrive
    return x[:, order], 2.0 * y[order] - 1.0, w[order], table["_n"].to_numpy()[order], splits


# -- boosting ----------------------------------------------------------------

def features_per_node(strategy: str, n: int) -> int:
    named = {"all": n, "auto": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n)))}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * n)


def boost(x, y, weight, count, splits: list[list[float]], booster: GBTClassifier) -> list[dict[str, np.ndarray]]:
    """The nodes of every tree, level by level; a node's children come after it."""
    margin = np.zeros(len(y))
    trees = []
    for m in range(booster.getMaxIter()):
        rng = np.random.default_rng([booster.getSeed() & (2**63 - 1), m])
        share = booster.getSubsamplingRate()
        drawn = rng.binomial(count, share) if share < 1 else count
        with np.errstate(over="ignore"):
            target = y if m == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        tree, value = grow(x, drawn.astype(float), weight, target, splits, booster, rng)
        margin += value * (1.0 if m == 0 else booster.getStepSize())
        trees.append(tree)
    return trees


def grow(x, drawn, weight, target, splits, booster: GBTClassifier, rng) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """One regression tree over the drawn rows, and its value for every cell."""
    features, bins = len(x), max(len(p) for p in splits) + 1
    per_node = features_per_node(booster.getFeatureSubsetStrategy(), features)
    least, min_gain = max(1, booster.getMinInstancesPerNode()), booster.getMinInfoGain()
    real = np.arange(bins - 1) < np.array([len(p) for p in splits])[:, None]  # (feature, threshold)
    w = drawn * weight
    g = w * target
    q = g * target
    value = np.zeros(len(target))
    live, node = np.arange(len(target)), np.zeros(len(target), np.int64)
    levels, open_nodes, made, above = [], 1, 1, None
    for level in range(booster.getMaxDepth() + 1):
        N, W, G, Q = (np.bincount(node, v, open_nodes) for v in (drawn, w, g, q))
        safe = np.where(W > 0, W, 1.0)
        prediction = G / safe
        impurity = Q / safe - prediction**2
        gain, feature, at = np.full(open_nodes, -1.0), np.full(open_nodes, -1), np.zeros(open_nodes, np.int64)
        if level < booster.getMaxDepth() and bins > 1:
            lefts = _left_sums(x, node, (drawn, w, g), open_nodes, bins, above)
            NL, WL, GL = lefts
            NR, WR, GR = (total[:, None, None] - left for total, left in ((N, NL), (W, WL), (G, GL)))
            allowed = real & (NL >= least) & (NR >= least) & (WL > 0) & (WR > 0)
            if per_node < features:
                allowed &= (rng.random((open_nodes, features)).argsort(1).argsort(1) < per_node)[:, :, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                gains = (GL**2 / WL + GR**2 / WR - (G**2 / safe)[:, None, None]) / safe[:, None, None]
            gains = np.where(allowed, gains, -1.0).reshape(open_nodes, -1)
            best = gains.argmax(1)
            top = gains[np.arange(open_nodes), best]
            # A gain below the rounding of the sums is none.
            splitting = (top >= min_gain) & (top > 1e-12 * Q / safe)
            gain = np.where(splitting, top, -1.0)
            feature, at = np.where(splitting, best // (bins - 1), -1), best % (bins - 1)
        splitting = feature >= 0
        rank = np.cumsum(splitting) - 1
        left = np.where(splitting, made + 2 * rank, -1)
        threshold = [splits[f][b] if f >= 0 else math.nan for f, b in zip(feature, at)]
        levels.append({
            "prediction": prediction, "impurity": impurity, "w": W, "g": G, "q": Q, "rawCount": N.astype(np.int64), "gain": gain,
            "leftChild": left, "rightChild": np.where(splitting, left + 1, -1), "featureIndex": feature, "threshold": np.array(threshold, float),
        })
        made += 2 * int(splitting.sum())
        ended = ~splitting[node]
        if ended.any():
            value[live[ended]] = prediction[node[ended]]
            keep = ~ended
            live, node, x, drawn, w, g, q = live[keep], node[keep], x[:, keep], drawn[keep], w[keep], g[keep], q[keep]
        if not len(live):
            break
        above = [s[splitting] for s in lefts]
        right = x[feature[node], np.arange(len(live))] > at[node]
        node = 2 * rank[node] + right
        open_nodes = 2 * int(splitting.sum())
    return {k: np.concatenate([lv[k] for lv in levels]) for k in levels[0]}, value


def _left_sums(x, node, values, nodes: int, bins: int, above) -> list[np.ndarray]:
    """Each value summed up to every threshold: (node, feature, threshold). Of two children
    only the one with fewer cells is summed; the other is the rest of their parent's (``above``)."""
    drawn = values[0] > 0
    if above is None:
        return _sums(x[:, drawn], node[drawn], [v[drawn] for v in values], nodes, bins)
    sizes = np.bincount(node, drawn, nodes).reshape(-1, 2)
    side = sizes.argmin(1)
    mine = np.flatnonzero(drawn & (side[node // 2] == node % 2))
    small = _sums(x[:, mine], node[mine] // 2, [v[mine] for v in values], nodes // 2, bins)
    out = [np.empty((nodes // 2, 2, *s.shape[1:])) for s in small]
    each = np.arange(nodes // 2)
    for o, s, parent in zip(out, small, above):
        o[each, side], o[each, 1 - side] = s, parent - s
    return [o.reshape(nodes, *o.shape[2:]) for o in out]


def _sums(x, node, values, nodes: int, bins: int) -> list[np.ndarray]:
    sums = [np.empty((nodes, len(x), bins - 1)) for _ in values]
    first = node * bins
    for f, column in enumerate(x):
        place = first + column
        for out, v in zip(sums, values):
            out[:, f] = np.bincount(place, v, nodes * bins).reshape(nodes, bins)[:, :-1].cumsum(1)
    return sums


# -- model -------------------------------------------------------------------

def _metadata(kind: str, uid: str, version: str, booster: GBTClassifier, params: list[str] | None = None, **more) -> str:
    wanted = [p for p in booster.params if params is None or p.name in params]
    return json.dumps({
        "class": f"org.apache.spark.ml.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": version, "uid": uid,
        "paramMap": {p.name: booster.getOrDefault(p) for p in wanted if booster.isSet(p)},
        "defaultParamMap": {p.name: booster.getOrDefault(p) for p in wanted if not booster.isSet(p) and booster.hasDefault(p)},
        **more,
    })


def to_model(spark: SparkSession, trees: list[dict[str, np.ndarray]], splits: list, booster: GBTClassifier) -> GBTClassificationModel:
    """Spark's own model, by way of its stored form."""
    path = new_folder(spark, "trees")
    version, tree_params = spark.version, ["maxDepth", "maxBins", "minInstancesPerNode", "minInfoGain", "seed", "featuresCol", "labelCol", "weightCol"]
    whole = _metadata("classification.GBTClassificationModel", booster.uid, version, booster, numFeatures=len(splits), numTrees=len(trees))
    each = [
        (t, _metadata("regression.DecisionTreeRegressionModel", f"{booster.uid}_{t}", version, booster, tree_params), 1.0 if t == 0 else booster.getStepSize())
        for t in range(len(trees))
    ]
    nodes = pa.table({
        "treeID": np.concatenate([np.full(len(tree["gain"]), t, np.int32) for t, tree in enumerate(trees)]),
        "id": np.concatenate([np.arange(len(tree["gain"]), dtype=np.int32) for tree in trees]),
        **{k: np.concatenate([tree[k] for tree in trees]) for k in trees[0]},
    })
    split = F.struct(
        F.col("featureIndex").cast("int").alias("featureIndex"),
        F.when(F.col("featureIndex") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    node = F.struct(
        "id", "prediction", "impurity", F.array("w", "g", "q").alias("impurityStats"), "rawCount", "gain",
        F.col("leftChild").cast("int").alias("leftChild"), F.col("rightChild").cast("int").alias("rightChild"), split.alias("split"),
    )
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame(nodes).select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


# -- scoring -----------------------------------------------------------------

@dataclass(frozen=True)
class FlatTrees:
    """All nodes of an ensemble; a leaf is its own left child and never sends a row right."""

    points: list[np.ndarray]  # thresholds per feature
    roots: np.ndarray
    depth: int
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray  # prediction times the tree's weight
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(p, c, "left") for p, c in zip(self.points, columns)]).astype(np.int16)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        parts = [self._walk(bins[:, i:i + 8_192]) for i in range(0, bins.shape[1], 8_192)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _walk(self, bins: np.ndarray) -> np.ndarray:
        n = bins.shape[1]
        flat, row, total = np.ascontiguousarray(bins).ravel(), np.arange(n), np.zeros(n)
        for root in self.roots:
            node = np.full(n, root)
            for _ in range(self.depth):
                node = self.left[node] + (flat[self.feature[node] * n + row] > self.bin[node])
            total += self.value[node]
        return total


def flat_trees(model: GBTClassificationModel, path: str | None = None) -> FlatTrees:
    """Read from the model's stored form (``path``, if it is stored); at most rounds x 2^(depth + 1) nodes."""
    spark = SparkSession.active()
    if path is None or not exists(spark, f"{path}/data/_SUCCESS"):
        path = new_folder(spark, "trees")
        model.write().save(path)
    n = F.col("nodeData")
    table = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["prediction"].alias("prediction"), n["leftChild"].alias("left"),
        n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
        F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
    ).toArrow().to_pandas().sort_values(["tree", "id"], ignore_index=True)
    tree, feature, threshold = (table[c].to_numpy() for c in ("tree", "feature", "threshold"))
    roots = np.flatnonzero(table["id"].to_numpy() == 0)
    inner, me = feature >= 0, np.arange(len(table))
    first = roots[tree]
    # Siblings side by side, so that going right is one step.
    place = np.empty(len(table), np.int64)
    place[roots] = np.arange(len(roots))
    lefts, rights = (first + table["left"].to_numpy())[inner], (first + table["right"].to_numpy())[inner]
    place[lefts] = len(roots) + 2 * np.arange(len(lefts))
    place[rights] = place[lefts] + 1
    points = [np.unique(threshold[inner & (feature == f)]) for f in range(model.numFeatures)]
    bins = np.full(len(table), np.iinfo(np.int16).max, np.int16)
    for f, p in enumerate(points):
        mine = inner & (feature == f)
        bins[mine] = np.searchsorted(p, threshold[mine])
    left = place.copy()
    left[inner] = place[lefts]
    order = np.argsort(place)
    depth, level = 0, place[roots]
    splits = np.zeros(len(table), bool)
    splits[place[inner]] = True
    while splits[level].any():
        level = np.concatenate([left[order][level[splits[level]]] + side for side in (0, 1)])
        depth += 1
    weights = np.array(model.treeWeights)
    pa.default_memory_pool().release_unused()
    return FlatTrees(
        points, place[roots], depth, np.where(inner, feature, 0)[order].astype(np.int64), bins[order], left[order],
        (table["prediction"].to_numpy() * weights[tree])[order],
    )


#: Margins by combination of bins, per ensemble, kept while a worker lives.
_KNOWN: dict[str, tuple[np.ndarray, np.ndarray]] = {}
KNOWN_ENSEMBLES, KNOWN_CELLS = 4, 1_000_000


def margins(trees: FlatTrees, columns: list[np.ndarray]) -> np.ndarray:
    """The margin of each row; a combination of bins already met is looked up."""
    bins = trees.bins(columns)
    sizes = [len(p) + 1 for p in trees.points]
    if math.prod(sizes) >= 2**62:
        return trees.margins(bins)
    code = np.zeros(bins.shape[1], np.int64)
    for column, size in zip(bins, sizes):
        code = code * size + column
    codes, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    known, values = _KNOWN.get(trees.key, (np.zeros(0, np.int64), np.zeros(0)))
    at = np.searchsorted(known, codes)
    met = at < len(known)
    met[met] = known[at[met]] == codes[met]
    found = np.empty(len(codes))
    found[met] = values[at[met]]
    found[~met] = trees.margins(bins[:, first[~met]])
    if not met.all() and len(known) + (~met).sum() <= KNOWN_CELLS:
        while len(_KNOWN) >= KNOWN_ENSEMBLES and trees.key not in _KNOWN:
            _KNOWN.pop(next(iter(_KNOWN)))
        _KNOWN[trees.key] = (np.insert(known, at[~met], codes[~met]), np.insert(values, at[~met], found[~met]))
    return found[inverse]


def tree_stages(model: PipelineModel) -> tuple[VectorAssembler, GBTClassificationModel] | None:
    """Assembler and trees of a detector of ``train_detector``; None for any other model."""
    if len(model.stages) == 2 and isinstance(model.stages[0], VectorAssembler) and isinstance(model.stages[1], GBTClassificationModel):
        return model.stages[0], model.stages[1]
    return None


def margin_column(assembler: VectorAssembler, model: GBTClassificationModel, path: str | None = None) -> Column:
    """The margin by the flat trees of a model, which is read from ``path`` if it is stored there."""
    trees = getattr(model, "_flat", None)
    if trees is None:
        trees = model._flat = flat_trees(model, path)
    shared = SparkSession.active().sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def margin(*columns: pd.Series) -> pd.Series:
        values = [c.to_numpy(dtype=float, na_value=np.nan) for c in columns]
        if any(np.isnan(v).any() for v in values):
            raise ValueError("a feature is null or NaN")
        return pd.Series(margins(shared.value, values))

    return margin(*[F.col(f"`{c}`").cast("double") for c in assembler.getInputCols()])
