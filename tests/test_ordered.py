import random

import pytest
from pyspark.sql import Window, functions as F

from flowtriage import schema as S
from flowtriage.operators import ordered


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    rows = [(i + 1, round(rng.random(), 4), rng.randrange(2), rng.randrange(3)) for i in range(2_500)]
    return spark.createDataFrame(rows, "step long, score double, y int, action int").repartition(5).cache()


@pytest.mark.parametrize("block_rows", [37, 100, 1_000, 65_536])
def test_density_equals_global_window(scored, block_rows):
    before = F.coalesce(F.avg("score").over(Window.orderBy("step").rowsBetween(-100, -1)), F.lit(0.0))
    after = F.avg("score").over(Window.orderBy("step").rowsBetween(-99, 0))
    plain = scored.select("step", before.alias("b"), after.alias("a"))
    blocked = ordered.threat_density(scored, "score", block_rows=block_rows)
    joined = plain.join(blocked, "step")
    assert joined.count() == 2_500
    worst = joined.agg(F.max(F.abs(F.col("b") - F.col("density_before"))), F.max(F.abs(F.col("a") - F.col("density_after")))).first()
    assert max(worst) < 1e-12


@pytest.mark.parametrize("block_rows", [1, 64, 65_536])
def test_running_sum_equals_global_window(scored, block_rows):
    total = F.sum("score").over(Window.orderBy("step"))
    plain = scored.select("step", total.alias("t"))
    blocked = ordered.running_sums(scored, {"s": F.col("score")}, block_rows=block_rows)
    worst = plain.join(blocked, "step").agg(F.count("*"), F.max(F.abs(F.col("t") - F.col("s")))).first()
    assert worst[0] == 2_500 and worst[1] < 1e-8


def test_running_confusion(scored):
    rows = ordered.running_confusion(scored, "y", F.col("action") >= 1, F.col("action") == 2, block_rows=50).orderBy("step").collect()
    tp = fp = fn = tn = 0
    for r in rows:
        tp += r["y"] == 1 and r["action"] >= 1
        fp += r["y"] == 0 and r["action"] == 2
        fn += r["y"] == 1 and r["action"] == 0
        tn += r["y"] == 0 and r["action"] < 2
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (tp, fp, fn, tn)
    assert r["precision"] == tp / (tp + fp) and r["recall"] == tp / (tp + fn)


@pytest.mark.parametrize("slices", [2, 7, 64])
def test_dense_step(spark, slices):
    rng = random.Random(4)
    # A lopsided distribution: most keys in one narrow range.
    keys = sorted({rng.randrange(1_000) if rng.random() < 0.8 else rng.randrange(10**12) for _ in range(900)})
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    found = {r["k"]: r["step"] for r in ordered.dense_step(df, "k", slices=slices).collect()}
    assert found == {k: i + 1 for i, k in enumerate(keys)}


def test_dense_step_small(spark):
    assert ordered.dense_step(spark.createDataFrame([(5,)], "k long"), "k").first()["step"] == 1
    assert ordered.dense_step(spark.createDataFrame([], "k long"), "k").count() == 0


def test_no_pass_over_rows_in_one_partition(scored):
    plan = ordered.threat_density(scored, "score", dense=True)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_density_counts_rows_not_steps(spark):
    rows = [(s, (s * 37 % 101) / 100) for s in range(1, 2_000) if s % 10]
    found = ordered.threat_density(spark.createDataFrame(rows, "step long, score double"), "score", block_rows=150).collect()
    scores = [x for _, x in rows]
    place = {s: i for i, (s, _) in enumerate(rows)}
    assert len(found) == len(rows)
    for r in found:
        i = place[r["step"]]
        before = scores[max(0, i - 100) : i]
        assert abs(r["density_before"] - (sum(before) / len(before) if before else 0.0)) < 1e-9


def test_load_phases_keep_all_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "b", 9), (2, None, 9), (3, "a", 9)], "id long, file string, phase int")
    found = {r["id"]: (r["analyst_load"], r["phase"]) for r in ordered.load_phases(rows, "file").collect()}
    assert found == {3: (S.LOAD_PHASES[0], 9), 1: (S.LOAD_PHASES[1], 9), 2: (S.LOAD_PHASES[2], 9)}
