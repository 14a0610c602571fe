"""Histogram boosting: splits against brute force, continued fits against one fit, odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage.operators import boosting as B


def table(spark, n=400, seed=3, nulls=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rnd.randrange(12), rnd.choice([0.5, 1.5, 2.5, 7.0])
        y = int((a > 6) ^ (rnd.random() < 0.15))
        rows.append((i, None if nulls and i % 9 == 0 else float(a), b, y))
    return spark.createDataFrame(rows, "id long, a double, b double, y int"), rows


def brute_split(rows, s):
    """Every threshold of every feature, margins 0; nulls left."""
    g = [0.5 - r[3] for r in rows]
    G, H = sum(g), 0.25 * len(rows)
    best = None
    for fi, col in enumerate((1, 2)):
        for t in sorted({r[col] for r in rows if r[col] is not None}):
            left = [r[col] is None or r[col] <= t for r in rows]
            gl = sum(x for x, l in zip(g, left) if l)
            hl = 0.25 * sum(left)
            if hl < s.min_child_weight or H - hl < s.min_child_weight:
                continue
            gain = 0.5 * (B._score(gl, hl, s) + B._score(G - gl, H - hl, s) - B._score(G, H, s)) - s.gamma
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, ("a", "b")[fi], t, B.leaf_weight(gl, hl, s), B.leaf_weight(G - gl, H - hl, s))
    return best


@pytest.mark.parametrize("nulls", [False, True])
def test_depth_one_split_equals_brute_force(spark, nulls):
    df, rows = table(spark, nulls=nulls)
    s = B.BoostSettings(rounds=1, depth=1, eta=0.7, gamma=0.2, l2=2.0, l1=0.3)
    tree = B.fit(df, ["a", "b"], "y", s, base_margin=0.0).trees[0]
    gain, feature, t, wl, wr = brute_split(rows, s)
    assert tree[0] == ("split", feature, t)
    assert tree[1][1] == pytest.approx(wl) and tree[2][1] == pytest.approx(wr)
    fitted = B.fit(df, ["a", "b"], "y", s, base_margin=0.0)
    assert fitted.gains[0, 0] == pytest.approx(gain)
    assert fitted.importance() == {"a": 1.0 if feature == "a" else 0.0, "b": 1.0 if feature == "b" else 0.0}
    assert B.Ensemble.from_table(fitted.table(spark), ["a", "b"]).gains == fitted.gains


def test_continued_fit_equals_one_fit_tree_for_tree(spark):
    df, _ = table(spark, n=600, seed=5)
    s = B.BoostSettings(rounds=2, depth=3, eta=0.3, gamma=0.01, l1=0.05, row_sample=0.7, column_sample=0.99)
    first = B.fit(df, ["a", "b"], "y", s, row_key="id")
    stored = B.Ensemble.from_table(first.table(spark), ["a", "b"])
    assert stored.trees == first.trees and stored.base_margin == first.base_margin
    continued = B.fit(df, ["a", "b"], "y", s, start=stored, row_key="id")
    whole = B.fit(df, ["a", "b"], "y", B.BoostSettings(**{**s.__dict__, "rounds": 4}), row_key="id")
    assert continued.trees[:2] == first.trees
    assert len(continued.trees) == 4
    for mine, theirs in zip(continued.trees, whole.trees):
        assert mine.keys() == theirs.keys()
        for node in mine:
            assert mine[node][:2] == theirs[node][:2]
            assert mine[node][-1] == pytest.approx(theirs[node][-1])


def test_boosting_lowers_the_loss(spark):
    df, rows = table(spark, n=800, seed=7)
    fitted = B.fit(df, ["a", "b"], "y", B.BoostSettings(rounds=20, depth=4))
    p = [r.probability for r in B.predict(df, fitted).orderBy("id").collect()]
    loss = -np.mean([math.log(q if r[3] else 1 - q) for q, r in zip(p, rows)])
    prior = np.mean([r[3] for r in rows])
    assert loss < -(prior * math.log(prior) + (1 - prior) * math.log(1 - prior)) - 0.2


def test_empty_and_one_class(spark):
    df, _ = table(spark)
    empty = B.fit(df.limit(0), ["a", "b"], "y", B.BoostSettings(rounds=2, depth=2))
    assert empty.base_margin == 0.0 and all(t == {0: ("leaf", 0.0)} for t in empty.trees)
    ones = B.fit(df.withColumn("y", F.lit(1)), ["a", "b"], "y", B.BoostSettings(rounds=1, depth=2))
    assert ones.base_margin > 0 and ones.trees[0][0][0] == "leaf"
