"""Policy operators against a sequential loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.operators import ordered, policy
from flowtriage.sources import sinks


def sequential_run(rows, q=None, n=None, base=0):
    """The online rule, one flow at a time: decide, reward, update."""
    q = np.zeros((20, 20, 5, 3, 3)) if q is None else q
    n = np.zeros((20, 20, 5, 3, 3), dtype=int) if n is None else n
    recent, log = [], []

    def place(score, load, port):
        density = float(np.mean(recent)) if recent else 0.0
        kind = 0 if port in S.WEB_PORTS else 1 if port in S.AUTH_PORTS else 2
        return int(np.clip(score * 20, 0, 19)), int(np.clip(load * 20, 0, 19)), int(np.clip(density * 5, 0, 4)), kind

    for step, score, load, port, truth in rows:
        state = place(score, load, port)
        recent.append(score)
        del recent[:-100]
        visits = n[state]
        band = 2 if score >= 0.7 else 1 if score >= 0.3 else 0
        if visits.sum() == 0:
            action = band
        else:
            values = [np.inf if v == 0 else q[state][a] + np.sqrt(np.log(base + step) / v) for a, v in enumerate(visits)]
            if band == 2 or (band == 1 and np.inf in values[1:]):
                values[0] = -np.inf
            open_ = [a for a in range(3) if values[a] == np.inf]
            order = {2: [2, 1, 0], 1: [1, 2, 0], 0: [0, 1, 2]}[band]
            action = next(a for a in order if a in open_) if len(open_) > 1 else int(np.argmax(values))
        if truth:
            gain = [-3000 * (1 + score), 50 * (1 - load), 100 * (1 + score)][action]
        else:
            gain = [15, -75, -120 * (1 + load)][action]
        cell = place(score, load, port) + (action,)
        n[cell] += 1
        q[cell] += 0.15 / (1 + 0.001 * n[cell]) * (gain - q[cell])
        log.append((step, action, gain))
    return log, q, n


def make_flows(count, seed):
    rng = random.Random(seed)
    return [
        (i + 1, round(min(1.0, abs(rng.gauss(0.2, 0.35))), 4), rng.choice(S.LOAD_PHASES[:2]), rng.choice([80, 22, 53]), int(rng.random() < 0.4))
        for i in range(count)
    ]


FLOW = "step long, threat_score double, analyst_load double, dst_port int, y int"


@pytest.mark.parametrize("rows_per_round", [10_000_000, 300])
def test_replay_equals_loop(spark, rows_per_round):
    rows = make_flows(1_000, seed=6)
    log, q, n = sequential_run(rows)
    flows = ordered.threat_density(spark.createDataFrame(rows, FLOW), "threat_score", block_rows=150)
    replayed = policy.replay_online(flows, policy.empty_policy(spark), rows_per_round=rows_per_round)
    found = {r["step"]: (r["action"], r["reward"]) for r in replayed.collect()}
    assert {s: a for s, (a, _) in found.items()} == {s: a for s, a, _ in log}
    assert sum(g for _, g in found.values()) == pytest.approx(sum(g for *_, g in log))
    final = policy.policy_after(replayed, policy.empty_policy(spark)).collect()
    assert sum(r["visits"] for r in final) == 1_000
    for r in final:
        cell = tuple(r[c] for c in policy.CELL)
        assert r["visits"] == n[cell] and r["q"] == pytest.approx(q[cell], rel=1e-12)


def test_replay_continues_a_stored_policy(spark):
    rows = make_flows(800, seed=2)
    log, *_ = sequential_run(rows)
    flows = ordered.threat_density(spark.createDataFrame(rows, FLOW), "threat_score")
    first = policy.replay_online(flows.filter("step <= 500"), policy.empty_policy(spark))
    middle = policy.policy_after(first, policy.empty_policy(spark))
    second = policy.replay_online(flows.filter("step > 500"), middle)
    assert {r["step"]: r["action"] for r in second.collect()} == {s: a for s, a, _ in log if s > 500}


@pytest.mark.parametrize("block_rows", [13, 100_000])
def test_fold_equals_loop(spark, block_rows):
    rng = random.Random(8)
    # One hot cell, with a stored value and many visits, and a few cold ones.
    rows = [(i + 1, 0 if rng.random() < 0.7 else rng.randrange(1, 4), 0, 0, 0, rng.randrange(2), rng.uniform(-3000, 200)) for i in range(1_500)]
    start = [(0, 0, 0, 0, 0, -40.0, 250_000), (7, 0, 0, 0, 2, 5.0, 3)]
    q, n = {r[:5]: r[5] for r in start}, {r[:5]: r[6] for r in start}
    for step, tb, lb, db, pb, action, gain in rows:
        cell = (tb, lb, db, pb, action)
        n[cell] = n.get(cell, 0) + 1
        q[cell] = q.get(cell, 0.0) + 0.15 / (1 + 0.001 * n[cell]) * (gain - q.get(cell, 0.0))
    updates = spark.createDataFrame(rows, "step long, tb int, lb int, db int, pb int, action int, reward double")
    folded = policy.fold_updates(updates, spark.createDataFrame(start, S.POLICY_SCHEMA), block_rows=block_rows).collect()
    assert {tuple(r[c] for c in policy.CELL): r["visits"] for r in folded} == n
    for r in folded:
        assert r["q"] == pytest.approx(q[tuple(r[c] for c in policy.CELL)], rel=1e-9)


def test_decision_rule_branches(spark):
    # (visits per action, values, score, expected action)
    cases = [
        ((0, 0, 0), (0, 0, 0), 0.9, 2), ((0, 0, 0), (0, 0, 0), 0.5, 1), ((0, 0, 0), (0, 0, 0), 0.1, 0),
        ((4, 0, 0), (9, 0, 0), 0.9, 2), ((4, 0, 0), (9, 0, 0), 0.5, 1), ((0, 4, 0), (0, 9, 0), 0.1, 0),
        ((4, 4, 0), (9, 99, 0), 0.5, 2), ((0, 4, 4), (0, 9, 9), 0.5, 0), ((0, 4, 4), (0, 9, 9), 0.8, 1),
        ((1, 1, 1), (7, 7, 7), 0.1, 0), ((1, 1, 1), (7, 7, 7), 0.9, 1), ((5, 5, 5), (1, 2, 3), 0.1, 2),
    ]
    rows, cells = [], []
    for i, (visits, values, score, _) in enumerate(cases):
        rows.append((i + 1, score, i / 20 + 0.01, 0.0, 80))
        tb = min(19, int(score * 20))
        cells += [(tb, i, 0, 0, a, float(values[a]), visits[a]) for a in range(3)]
    flows = spark.createDataFrame(rows, "step long, threat_score double, analyst_load double, density_before double, dst_port int")
    decided = policy.decide(flows, spark.createDataFrame(cells, S.POLICY_SCHEMA), "threat_score", F.col("analyst_load"), base_steps=50)
    assert [r["action"] for r in decided.orderBy("step").collect()] == [c[3] for c in cases]


def test_rewards(spark):
    cases = [(1, 0, 0.5, 0.8, -5400.0), (1, 1, 0.5, 0.8, 25.0), (1, 2, 0.5, 0.8, 180.0), (0, 0, 0.5, 0.8, 15.0), (0, 1, 0.5, 0.8, -75.0), (0, 2, 0.5, 0.8, -180.0)]
    df = spark.createDataFrame(cases, "y int, a int, l double, s double, r double")
    for row in df.withColumn("found", triage.reward(F.col("y"), F.col("a"), F.col("l"), F.col("s"))).collect():
        assert row["found"] == pytest.approx(row["r"])


def test_buckets_clip(spark):
    df = spark.createDataFrame([(-0.1,), (0.0,), (0.05,), (0.999,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(triage.bucket(F.col("x"), 20)).collect()] == [0, 0, 1, 19, 19, 19]


def test_policy_storage_and_migration(spark, tmp_path):
    folder = str(tmp_path / "policy")
    assert sinks.load_policy(spark, folder)[1] is False
    cells = spark.createDataFrame([(1, 2, 3, 0, 1, 5.5, 7)], S.POLICY_SCHEMA)
    assert sinks.save_policy(cells, folder) == 0
    assert sinks.save_policy(cells.withColumn("visits", F.lit(9).cast("long")), folder) == 1
    loaded, usable = sinks.load_policy(spark, folder)
    assert usable and loaded.first()["visits"] == 9
    assert loaded.select(policy.policy_steps(loaded).alias("n")).first()["n"] == 9
    assert sinks.load_policy(spark, folder, at_most=0)[0].first()["visits"] == 7

    old = str(tmp_path / "old")
    sinks.save_version(cells.drop("pb"), old, 0)
    migrated, usable = sinks.load_policy(spark, old)
    assert usable and sorted(r["pb"] for r in migrated.collect()) == [0, 1, 2]

    other = str(tmp_path / "other")
    sinks.save_version(cells.drop("lb"), other, 0)
    fresh, usable = sinks.load_policy(spark, other)
    assert not usable and fresh.count() == 0
