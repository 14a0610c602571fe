import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage.operators import metrics, models


def test_label_medians_are_exact(spark):
    rng = random.Random(3)
    rows = []
    for i in range(6_000):
        label = "Benign " if i % 3 == 0 else rng.choice(["Bot", "DoS", "rare"] if i < 12 else ["Bot", "DoS"])
        # Heavy ties, a wide range, and missing values.
        rows.append((label, rng.choice([0.0, 0.0, rng.gauss(0, 1e6)]), float(rng.randrange(5)), None if i % 7 == 0 else rng.random()))
    df = spark.createDataFrame(rows, "label string, a double, b double, c double").repartition(6)
    found = {(r["label"], r["feature"]): (r["median"], r["n"]) for r in metrics.label_medians(df, F.col("label"), ["a", "b", "c"]).collect()}
    for name in ("benign", "Bot", "DoS"):
        members = [r for r in rows if (r[0].strip() if r[0].strip() != "Benign" else "benign") == name]
        for i, feature in enumerate("abc", start=1):
            values = [r[i] for r in members if r[i] is not None]
            assert found[name, feature] == (pytest.approx(np.median(values), rel=1e-12), len(members))


def test_labels_below_the_minimum_are_left_out(spark):
    rows = [("Bot", 1.0)] * 4 + [("DoS", 2.0)] * 5 + [("Benign", 3.0)] * 2
    df = spark.createDataFrame(rows, "label string, a double")
    assert {r["label"] for r in metrics.label_medians(df, F.col("label"), ["a"]).collect()} == {"DoS", "benign"}


def test_rates_with_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0, 0), (1, 0, 3, 0), (0, 2, 0, 6)], "tp long, fp long, fn long, tn long")
    rows = metrics.with_reported_rates(df).collect()
    assert (rows[0]["precision"], rows[0]["recall"], rows[0]["f1"], rows[0]["fpr"]) == (0, 0, 0, 0)
    # P = 1, R = .25: the compatible F1 divides by 1.25, the plain one too.
    assert rows[1]["f1"] == rows[1]["f1_compat"] == 0.4
    assert rows[2]["fpr"] == 0.25
    low = metrics.with_reported_rates(spark.createDataFrame([(1, 3, 3, 0)], "tp long, fp long, fn long, tn long")).first()
    assert low["f1"] == 0.25 and low["f1_compat"] == 0.125


def test_unlabelled_rows_do_not_count(spark):
    df = spark.createDataFrame([(1, True), (None, True), (0, False)], "y int, hit boolean")
    row = metrics.confusion(df, F.col("y"), F.col("hit")).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 0, 0, 1)


def test_policy_load_share(spark):
    cells = [(0, 6, 0, 0, a, 0.0, 10 * (a + 1)) for a in range(3)] + [(0, 5, 0, 0, 0, 0.0, 99)]
    df = spark.createDataFrame(cells, "tb int, lb int, db int, pb int, action int, q double, visits long")
    row = metrics.actions_by_load_from_policy(df).first()
    assert row["analyst_load"] == 0.3 and (row["dismiss"], row["monitor"], row["escalate"]) == (10, 20, 30)
    assert row["escalate_pct"] == 50.0


def test_scaler_keeps_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = models.fit_scaler(df, ["a", "b"])
    assert scaler == {"a": (2.0, 1.0), "b": (5.0, 1.0)}
    assert [tuple(r) for r in models.standardise(df, scaler).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert [tuple(r) for r in models.standardise_inline(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=3_000), "b": rng.integers(0, 5, 700).astype(float), "c": np.array([2.5]), None: rng.exponential(size=10)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("d", None)]
    shares = (0.0, 0.25, 0.5, 0.75, 1.0)
    found = metrics.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares).collect()
    assert len(found) == len(groups) * len(shares)
    for r in found:
        assert r["quantile"] == pytest.approx(np.quantile(groups[r["k"]], shares[r["at"]]), rel=1e-12), r
