"""Second-order gradient boosting of trees from histograms, with continued fitting.

Every row carries a margin; the logistic loss gives it a gradient g and a
hessian h (times its weight). A tree is grown level by level: one
``groupBy(node, feature, bin)`` sums g and h (combined map-side, so the
shuffle is the size of the histogram, never of the rows), the driver reads
that histogram (open nodes x features x bins rows) and picks each node's split
by the penalised gain

    gain = 1/2 [S(G_L, H_L) + S(G_R, H_R) - S(G, H)] - gamma,
    S(G, H) = T(G)^2 / (H + lambda),  T(G) = sign(G) max(|G| - alpha, 0),

and a leaf's weight is -eta T(G) / (H + lambda). Rows then move to children by
a column expression; nothing but the histogram leaves the executors.

Bins: a feature with at most ``bins`` distinct values splits between any two
of them (exact); others split at ``bins`` quantiles of a sketch. Nulls go
left. Rows and features are sampled per tree by hashing, so a refit sees the
same sample. An ensemble is stored as rows (tree, node, feature, threshold,
weight, gain); importance is each feature's share of the split gains; ``fit(..., start=stored)`` computes the stored trees' margins and
adds rounds after them, leaving the stored trees as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from flowtriage.sources.workspace import durable

TREE_SCHEMA = "tree int, node int, feature string, threshold double, weight double, gain double"


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 20
    depth: int = 4
    eta: float = 0.3
    gamma: float = 0.0
    l2: float = 1.0
    l1: float = 0.0
    bins: int = 32
    min_child_weight: float = 1.0
    row_sample: float = 1.0
    column_sample: float = 1.0
    seed: int = 7
    #: Rounds between written tables of margins (cuts the lineage).
    checkpoint_every: int = 5


@dataclass
class Ensemble:
    features: list[str]
    base_margin: float
    trees: list[dict[int, tuple]] = field(default_factory=list)  # node -> ("split", feature, threshold) | ("leaf", weight)
    gains: dict[tuple[int, int], float] = field(default_factory=dict)  # (tree, node) of a split -> its gain

    def rows(self) -> list[tuple]:
        out = [(-1, 0, None, None, self.base_margin, None)]
        for t, tree in enumerate(self.trees):
            for node, what in sorted(tree.items()):
                gain = self.gains.get((t, node))
                out.append((t, node, what[1], what[2], None, gain) if what[0] == "split" else (t, node, None, None, what[1], None))
        return out

    def importance(self) -> dict[str, float]:
        """Share of the summed split gains per feature (every feature listed, zero if unused)."""
        total = {f: 0.0 for f in self.features}
        for (t, node), gain in self.gains.items():
            total[self.trees[t][node][1]] += gain
        whole = sum(total.values())
        return {f: (g / whole if whole > 0 else 0.0) for f, g in total.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), TREE_SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame, features: list[str]) -> "Ensemble":
        rows = table.collect()  # the trees: at most rounds x 2^(depth+1) rows
        base = next(r.weight for r in rows if r.tree == -1)
        trees: dict[int, dict] = {}
        gains = {}
        for r in rows:
            if r.tree >= 0:
                trees.setdefault(r.tree, {})[r.node] = ("split", r.feature, r.threshold) if r.feature else ("leaf", r.weight)
                gain = r.asDict().get("gain")  # tables stored without gains load too
                if r.feature and gain is not None:
                    gains[r.tree, r.node] = gain
        return cls(features, base, [trees[t] for t in sorted(trees)], gains)

    def margin(self) -> Column:
        total = F.lit(self.base_margin)
        for tree in self.trees:
            total = total + tree_value(tree)
        return total


def tree_value(tree: dict[int, tuple], node: int = 0) -> Column:
    what = tree[node]
    if what[0] == "leaf":
        return F.lit(what[1])
    x = F.col(what[1])
    return F.when(x.isNull() | (x <= what[2]), tree_value(tree, 2 * node + 1)).otherwise(tree_value(tree, 2 * node + 2))


def bin_edges(df: DataFrame, features: list[str], bins: int) -> dict[str, list[float]]:
    """Split points per feature: every distinct value when there are few, else quantiles of a sketch."""
    sketch = df.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    few = [f for f in features if sketch[f] <= 2 * bins]
    edges: dict[str, list[float]] = {}
    if few:
        sets = df.agg(*[F.array_sort(F.collect_set(F.col(f).cast("double"))).alias(f) for f in few]).first()
        for f in few:
            if len(sets[f]) <= bins:
                edges[f] = list(sets[f])
    rest = [f for f in features if f not in edges]
    if rest:
        probabilities = [k / bins for k in range(1, bins)]
        found = df.agg(*[F.percentile_approx(F.col(f).cast("double"), probabilities, 10_000).alias(f) for f in rest]).first()
        for f in rest:
            edges[f] = sorted(set(found[f] or []))
    return edges


def _bin(x: Column, edges: list[float]) -> Column:
    """Edges below x; a null counts as below all of them."""
    if not edges:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)), F.lit(0))


def _shrink(g: float, l1: float) -> float:
    return math.copysign(max(abs(g) - l1, 0.0), g)


def _score(g: float, h: float, s: BoostSettings) -> float:
    return _shrink(g, s.l1) ** 2 / (h + s.l2)


def leaf_weight(g: float, h: float, s: BoostSettings) -> float:
    return -s.eta * _shrink(g, s.l1) / (h + s.l2)


def best_split(hist: dict[tuple[int, int], tuple[float, float]], n_bins: int, g: float, h: float, s: BoostSettings):
    """(gain, bin, left G, left H) of the best split of one node on one feature; bins are summed left to right."""
    best = None
    gl = hl = 0.0
    for b in range(n_bins):
        dg, dh = hist.get(b, (0.0, 0.0))
        gl, hl = gl + dg, hl + dh
        gr, hr = g - gl, h - hl
        if hl < s.min_child_weight or hr < s.min_child_weight:
            continue
        gain = 0.5 * (_score(gl, hl, s) + _score(gr, hr, s) - _score(g, h, s)) - s.gamma
        if best is None or gain > best[0]:
            best = (gain, b, gl, hl)
    return best


def _sampled(key: Column, rate: float, seed: int, tree: int) -> Column:
    if rate >= 1.0:
        return F.lit(True)
    return (F.xxhash64(key, F.lit(seed), F.lit(tree)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)) < rate


def _feature_sample(features: list[str], rate: float, seed: int, tree: int) -> list[str]:
    if rate >= 1.0:
        return features
    import zlib

    kept = [f for f in features if zlib.crc32(f"{seed}:{tree}:{f}".encode()) / 2**32 < rate]
    return kept or [min(features, key=lambda f: zlib.crc32(f"{seed}:{tree}:{f}".encode()))]


def fit(
    df: DataFrame,
    features: list[str],
    label: str,
    settings: BoostSettings = BoostSettings(),
    weight: str | None = None,
    start: Ensemble | None = None,
    base_margin: float | None = None,
    row_key: str | None = None,
) -> Ensemble:
    """Boost ``settings.rounds`` trees after ``start`` (or after a prior margin: the label's log odds unless given)."""
    s = settings
    y = F.col(label).cast("double")
    rows = df.where(y.isNotNull())
    if start is None:
        if base_margin is None:
            pos, n = rows.agg(F.sum(y), F.count("*")).first()
            pos, n = pos or 0.0, n or 0
            base_margin = math.log((pos + 0.5) / (n - pos + 0.5)) if n else 0.0
        ensemble = Ensemble(list(features), base_margin)
    else:
        ensemble = Ensemble(list(features), start.base_margin, list(start.trees), dict(start.gains))
    edges = bin_edges(rows, features, s.bins)
    key = F.col(row_key) if row_key else F.monotonically_increasing_id()
    work = rows.select(
        *[_bin(F.col(f).cast("double"), edges[f]).alias(f"_b{i}") for i, f in enumerate(features)],
        y.alias("_y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        ensemble.margin().alias("_m") if ensemble.trees else F.lit(ensemble.base_margin).alias("_m"),
        *[F.col(f) for f in features],
        key.alias("_key"),
    )
    work = durable(work, "boosting")
    first = len(ensemble.trees)
    for r in range(s.rounds):
        t = first + r
        tree, gains = _grow(work, features, edges, s, t)
        ensemble.trees.append(tree)
        ensemble.gains.update({(t, node): gain for node, gain in gains.items()})
        work = work.withColumn("_m", F.col("_m") + tree_value(tree))
        if (r + 1) % s.checkpoint_every == 0 and r + 1 < s.rounds:
            work = durable(work, "boosting")
    return ensemble


def _grow(work: DataFrame, features: list[str], edges: dict[str, list[float]], s: BoostSettings, t: int) -> tuple[dict, dict]:
    p = 1 / (1 + F.exp(-F.col("_m")))
    used = _feature_sample(features, s.column_sample, s.seed, t)
    index = {f: i for i, f in enumerate(features)}
    rows = work.where(_sampled(F.col("_key"), s.row_sample, s.seed, t)).select(
        *[F.col(f"_b{index[f]}") for f in used],
        (F.col("_w") * (p - F.col("_y"))).alias("_g"),
        (F.col("_w") * p * (1 - p)).alias("_h"),
        F.lit(0).alias("_node"),
    )
    totals = rows.agg(F.sum("_g"), F.sum("_h")).first()
    open_nodes = {0: (totals[0] or 0.0, totals[1] or 0.0)}
    tree: dict[int, tuple] = {}
    gains: dict[int, float] = {}
    for level in range(s.depth + 1):
        if not open_nodes:
            break
        if level == s.depth:
            for node, (g, h) in open_nodes.items():
                tree[node] = ("leaf", leaf_weight(g, h, s))
            break
        cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{index[f]}").alias("b")) for i, f in enumerate(used)])
        hist_rows = (
            rows.where(F.col("_node").isin(list(open_nodes)))
            .select("_node", "_g", "_h", F.inline(cells))
            .groupBy("_node", "f", "b")
            .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
            .collect()  # open nodes x features x bins rows
        )
        hist: dict[tuple[int, int], dict[int, tuple[float, float]]] = {}
        for r in hist_rows:
            hist.setdefault((r["_node"], r["f"]), {})[r["b"]] = (r["g"], r["h"])
        moves = {}
        next_open = {}
        for node, (g, h) in sorted(open_nodes.items()):
            choice = None
            for i, f in enumerate(used):
                found = best_split(hist.get((node, i), {}), len(edges[f]), g, h, s)
                if found and found[0] > 0 and (choice is None or found[0] > choice[0]):
                    choice = (found[0], i, *found[1:])
            if choice is None:
                tree[node] = ("leaf", leaf_weight(g, h, s))
                continue
            gain, i, b, gl, hl = choice
            f = used[i]
            tree[node] = ("split", f, float(edges[f][b]))
            gains[node] = gain
            moves[node] = (i, b)
            next_open[2 * node + 1] = (gl, hl)
            next_open[2 * node + 2] = (g - gl, h - hl)
        if moves:
            child = F.col("_node")
            for node, (i, b) in moves.items():
                goes_right = F.col(f"_b{index[used[i]]}") > b
                child = F.when(F.col("_node") == node, F.lit(2 * node + 1) + goes_right.cast("int")).otherwise(child)
            rows = rows.withColumn("_node", child)
        open_nodes = next_open
    return tree, gains


def predict(df: DataFrame, ensemble: Ensemble, out: str = "probability") -> DataFrame:
    return df.withColumn(out, 1 / (1 + F.exp(-ensemble.margin())))
