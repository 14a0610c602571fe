"""Contextual-bandit triage policy as a table.

A policy is a long table (tb, lb, db, pb, action, q, visits) of at most
18,000 rows: 20 threat x 20 load x 5 density x 3 port buckets x 3 actions.
That bound holds for any input, so a policy may be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.operators.ordered import BLOCK_ROWS, block_of, preceding_totals
from flowtriage.sources.workspace import durable, new_folder

STATE = ["tb", "lb", "db", "pb"]
CELL = [*STATE, "action"]


def empty_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], S.POLICY_SCHEMA)


def policy_states(policy: DataFrame) -> DataFrame:
    """One row per visited state with q0..q2 and n0..n2; at most 6,000 rows."""
    inside = (
        F.col("tb").between(0, S.THREAT_BUCKETS - 1)
        & F.col("lb").between(0, S.LOAD_BUCKETS - 1)
        & F.col("db").between(0, S.DENSITY_BUCKETS - 1)
        & F.col("pb").between(0, S.PORT_CLASS_COUNT - 1)
    )
    def pick(value: str, action: int, zero) -> Column:
        return F.coalesce(F.max(F.when(F.col("action") == action, F.col(value))), F.lit(zero))

    return policy.filter(inside).groupBy(*STATE).agg(
        *[pick("q", a, 0.0).alias(f"q{a}") for a in range(3)],
        *[pick("visits", a, 0).cast("long").alias(f"n{a}") for a in range(3)],
    )


def lookup_policy(flows: DataFrame, policy: DataFrame) -> DataFrame:
    """Attach q0..q2, n0..n2 of each flow's state; unknown states are all zero."""
    states = policy_states(policy)
    joined = flows.join(F.broadcast(states), STATE, "left")
    return joined.withColumns(
        {
            **{f"q{a}": F.coalesce(f"q{a}", F.lit(0.0)) for a in range(3)},
            **{f"n{a}": F.coalesce(f"n{a}", F.lit(0).cast("long")) for a in range(3)},
        }
    )


def cold_start_action(score: Column) -> Column:
    return F.when(score >= S.ESCALATE_BAND, 2).when(score >= S.MONITOR_BAND, 1).otherwise(0)


def upper_bounds(total_steps: Column) -> list[Column]:
    """Optimistic value per action; infinite while an action is unvisited."""
    return [
        F.when(F.col(f"n{a}") == 0, F.lit(float("inf"))).otherwise(
            F.col(f"q{a}") + S.UCB_WEIGHT * F.sqrt(F.ln(total_steps) / F.greatest(F.col(f"n{a}"), F.lit(1)))
        )
        for a in range(3)
    ]


def guarded_dismiss(score: Column, dismiss: Column) -> Column:
    """Dismiss is ruled out for likely threats, and while the middle band explores."""
    barred = (score >= S.ESCALATE_BAND) | (
        (score >= S.MONITOR_BAND) & ((F.col("n1") == 0) | (F.col("n2") == 0))
    )
    return F.when(barred, F.lit(float("-inf"))).otherwise(dismiss)


def choose_action(score: Column, values: list[Column]) -> Column:
    """Largest value; several unvisited actions follow the score band's priority."""
    infinite = [v == float("inf") for v in values]
    several = (sum((i.cast("int") for i in infinite[1:]), infinite[0].cast("int"))) > 1
    by_band = (
        F.when(score >= S.ESCALATE_BAND, F.when(infinite[2], 2).when(infinite[1], 1).otherwise(0))
        .when(score >= S.MONITOR_BAND, F.when(infinite[1], 1).when(infinite[2], 2).otherwise(0))
        .otherwise(F.when(infinite[0], 0).when(infinite[1], 1).otherwise(2))
    )
    first_best = (
        F.when((values[0] >= values[1]) & (values[0] >= values[2]), 0)
        .when(values[1] >= values[2], 1)
        .otherwise(2)
    )
    return F.when(several, by_band).otherwise(first_best)


def decide(
    flows: DataFrame,
    policy: DataFrame,
    score: str,
    load: Column,
    density: str = "density_before",
    dst_port: str = "dst_port",
    step: str = "step",
    base_steps: Column | int = 0,
) -> DataFrame:
    """Actions of a frozen policy: one broadcast join and row expressions.

    Adds the state, its values and visits, ``ucb0..2``, ``action`` and
    ``epsilon``. ``base_steps`` is the number of decisions taken before step 1
    (the policy's total visits when it continues an earlier run).
    """
    s = F.col(score)
    located = flows.withColumns(triage.state_columns(s, load, F.col(density), F.col(dst_port)))
    known = lookup_policy(located, policy)
    total = F.col(step) + base_steps
    bounds = upper_bounds(total)
    valued = known.withColumns(
        {"ucb0": guarded_dismiss(s, bounds[0]), "ucb1": bounds[1], "ucb2": bounds[2]}
    ).withColumn("state_visits", F.col("n0") + F.col("n1") + F.col("n2"))
    chosen = choose_action(s, [F.col("ucb0"), F.col("ucb1"), F.col("ucb2")])
    cold = F.col("state_visits") == 0
    return valued.withColumns(
        {
            "action": F.when(cold, cold_start_action(s)).otherwise(chosen),
            "epsilon": triage.exploration(F.col("state_visits")),
        }
    )


def policy_steps(policy: DataFrame) -> Column:
    """Decisions a stored policy has seen, as a scalar."""
    return policy.agg(F.coalesce(F.sum("visits"), F.lit(0))).scalar()


def _log_decay(visits: Column) -> Column:
    """ln of the product of (1 - learning rate) over visits 1..v, up to a constant.

    1 - lr(j) = (j + a) / (j + b) with b = 1 / decay and a = b - lr0 / decay, so
    the product is a ratio of gamma functions; their logarithms differ by the
    Stirling form below, written so that large arguments do not cancel.
    """
    b = 1 / S.LEARNING_DECAY
    h = S.LEARNING_RATE / S.LEARNING_DECAY
    x = visits + (b - h + 1)  # lnGamma(x) - lnGamma(x + h)
    y = x + h
    correction = (1 / x - 1 / y) / 12 - (1 / (x * x * x) - 1 / (y * y * y)) / 360
    return -(x - 0.5) * F.log1p(h / x) - h * F.ln(y) + correction


def fold_updates(
    updates: DataFrame,
    policy: DataFrame,
    reward: str = "reward",
    step: str = "step",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Policy after applying every update in step order.

    Applying Q += lr * (r - Q) repeatedly is linear in the rewards: the weight
    of an update depends only on its visit number and on the cell's final
    visit count. Visit numbers come from block-wise ranks, so no cell has to
    fit one task; the weighted rewards then reduce with a plain aggregation.
    """
    based = updates.select(*CELL, reward, step).withColumn("_blk", block_of(F.col(step), block_rows))
    counts = based.groupBy(*CELL, "_blk").agg(F.count("*").alias("n"))
    offsets = preceding_totals(counts, "_blk", ["n"], keys=tuple(CELL))
    added = counts.groupBy(*CELL).agg(F.sum("n").alias("added"))
    start = policy.select(*CELL, F.col("q").alias("q0"), F.col("visits").alias("v0"))
    # At most one row per policy cell.
    cells = added.join(start, CELL, "full_outer").select(
        *CELL,
        F.coalesce("q0", F.lit(0.0)).alias("q0"),
        F.coalesce("v0", F.lit(0).cast("long")).alias("v0"),
        F.coalesce("added", F.lit(0).cast("long")).alias("added"),
    )
    rank = F.row_number().over(Window.partitionBy(*CELL, "_blk").orderBy(step))
    numbered = (
        based.withColumn("_rn", rank)
        .join(offsets, [*CELL, "_blk"])
        .join(F.broadcast(cells), CELL)
        .withColumn("_v", F.col("v0") + F.col("before_n") + F.col("_rn"))
    )
    end = _log_decay(F.col("v0") + F.col("added"))
    weight = triage.learning_rate(F.col("_v")) * F.exp(end - _log_decay(F.col("_v")))
    gained = numbered.groupBy(*CELL).agg(F.sum(F.col(reward) * weight).alias("gained"))
    kept = F.col("q0") * F.exp(end - _log_decay(F.col("v0")))
    return cells.join(gained, CELL, "left").select(
        *CELL,
        (F.when(F.col("added") == 0, F.col("q0")).otherwise(kept + F.col("gained"))).alias("q"),
        (F.col("v0") + F.col("added")).alias("visits"),
    )


def migrate_without_ports(policy: DataFrame) -> DataFrame:
    """Copy a policy without port classes to every port class."""
    classes = F.array(*[F.lit(p) for p in range(S.PORT_CLASS_COUNT)])
    return policy.select("tb", "lb", "db", F.explode(classes).alias("pb"), "action", "q", "visits")


# -- exact online replay -----------------------------------------------------

REPLAY_ROWS = 4_000_000

REPLAY_COLUMNS = (
    "step long, tb int, lb int, pb int, db int, db_after int, score double, analyst_load double, "
    "truth int, total_steps long"
)
REPLAY_RESULT = (
    "step long, tb int, lb int, db int, db_after int, pb int, action int, reward double, "
    "epsilon double, q double, visits long"
)


def replay_online(
    flows: DataFrame,
    policy: DataFrame,
    score: str = "threat_score",
    truth: str = "y",
    load: str = "analyst_load",
    dst_port: str = "dst_port",
    step: str = "step",
    base_steps: int = 0,
    rows_per_round: int = REPLAY_ROWS,
    first_step: int | None = None,
    last_step: int | None = None,
) -> DataFrame:
    """Decide, observe and update for every flow, exactly in step order.

    A decision depends on earlier flows of the same (tb, lb, pb) only: scores
    and densities are known up front, and just the density bucket may differ
    between decision and update. Keys therefore replay in parallel.

    Steps are taken in rounds of ``rows_per_round``; the policy, at most
    18,000 rows, is carried from round to round. A hot key thus never puts
    more than one round's rows into a task, and those are streamed in sorted
    batches. Needs ``density_before`` and ``density_after`` (see
    ``ordered.threat_density``). Rows carry the updated cell's q and visits.
    """
    spark = flows.sparkSession
    prepared = flows.select(
        F.col(step).cast("long").alias("step"),
        *[
            e.alias(n)
            for n, e in triage.state_columns(
                F.col(score), F.col(load), F.col("density_before"), F.col(dst_port)
            ).items()
        ],
        triage.bucket(F.col("density_after"), S.DENSITY_BUCKETS).alias("db_after"),
        F.col(score).cast("double").alias("score"),
        F.col(load).cast("double").alias("analyst_load"),
        F.col(truth).cast("int").alias("truth"),
        (F.col(step) + base_steps).cast("long").alias("total_steps"),
    )
    if first_step is None or last_step is None:
        first_step, last_step = prepared.agg(F.min("step"), F.max("step")).first()
    if first_step is None:
        return spark.createDataFrame([], REPLAY_RESULT)

    rounds = range(first_step, last_step + 1, rows_per_round)
    if len(rounds) == 1:
        return _replay_round(prepared, policy)
    # Densities and buckets are computed once; every round then reads its own
    # range of steps from the written table.
    prepared = durable(prepared)
    results = new_folder(spark, "replay")
    for low in rounds:
        part = prepared.filter(F.col("step").between(low, low + rows_per_round - 1))
        path = f"{results}/first_step={low}"
        _replay_round(part, policy).write.parquet(path)
        done = spark.read.schema(REPLAY_RESULT).parquet(path)
        policy = durable(policy_after(done, policy))
    return spark.read.schema(REPLAY_RESULT).parquet(f"{results}/*")


def policy_after(replayed: DataFrame, policy: DataFrame) -> DataFrame:
    """The policy at the end of a replay: the newest value of each cell."""
    newest = replayed.groupBy("tb", "lb", F.col("db_after").alias("db"), "pb", "action").agg(
        F.max(F.struct("visits", "q")).alias("latest")
    )
    changed = newest.select(*CELL, F.col("latest.q").alias("q"), F.col("latest.visits").alias("visits"))
    untouched = policy.select(*CELL, "q", "visits").join(F.broadcast(changed.select(*CELL)), CELL, "left_anti")
    return changed.unionByName(untouched)


def _replay_round(part: DataFrame, policy: DataFrame) -> DataFrame:
    """Replay one round; policy rows travel with the flows of their key."""
    key = ["tb", "lb", "pb"]
    flows = part.withColumn("q", F.lit(0.0)).withColumn("visits", F.lit(0).cast("long")).withColumn(
        "action", F.lit(-1)
    )
    memory = policy.select(
        F.lit(-1).cast("long").alias("step"), "tb", "lb", "pb", "db", F.lit(-1).alias("db_after"),
        F.lit(0.0).alias("score"), F.lit(0.0).alias("analyst_load"), F.lit(-1).alias("truth"),
        F.lit(0).cast("long").alias("total_steps"), "q", "visits", "action",
    )
    ordered = flows.unionByName(memory).repartition(*key).sortWithinPartitions(*key, "step")
    return ordered.mapInPandas(_replay_partition, REPLAY_RESULT)


def _replay_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk sorted rows; the only state is the 15 cells of the current key."""
    current = None
    q = np.zeros((S.DENSITY_BUCKETS, 3))
    n = np.zeros((S.DENSITY_BUCKETS, 3), dtype=np.int64)
    for batch in batches:
        keys = list(zip(batch["tb"].tolist(), batch["lb"].tolist(), batch["pb"].tolist()))
        columns = [
            batch[c].tolist()
            for c in ("step", "db", "db_after", "score", "analyst_load", "truth", "total_steps", "action", "q", "visits")
        ]
        rows = []
        for key, step, db, db_after, score, load, truth, total, stored, value, seen in zip(keys, *columns):
            if key != current:
                current = key
                q[:] = 0.0
                n[:] = 0
            if step < 0:
                q[db, stored], n[db, stored] = value, seen
                continue
            action, epsilon = _online_action(q[db], n[db], score, total)
            gain = _online_reward(truth, action, load, score)
            n[db_after, action] += 1
            rate = S.LEARNING_RATE / (1.0 + S.LEARNING_DECAY * n[db_after, action])
            q[db_after, action] += rate * (gain - q[db_after, action])
            rows.append(
                (step, *key[:2], db, db_after, key[2], action, gain, epsilon,
                 float(q[db_after, action]), int(n[db_after, action]))
            )
        yield pd.DataFrame(
            rows,
            columns=["step", "tb", "lb", "db", "db_after", "pb", "action", "reward", "epsilon", "q", "visits"],
        ).astype({"step": "int64", "tb": "int32", "lb": "int32", "db": "int32", "db_after": "int32",
                  "pb": "int32", "action": "int32", "reward": "float64", "epsilon": "float64",
                  "q": "float64", "visits": "int64"})


def _online_action(q, n, score: float, total: int) -> tuple[int, float]:
    band = 2 if score >= S.ESCALATE_BAND else 1 if score >= S.MONITOR_BAND else 0
    visited = int(n.sum())
    if visited == 0:
        return band, 1.0
    epsilon = max(0.01, 1.0 / (1.0 + 0.001 * visited))
    fresh = [a for a in range(3) if n[a] == 0]
    if band == 2 or (band == 1 and (1 in fresh or 2 in fresh)):
        allowed = [1, 2]
    else:
        allowed = [0, 1, 2]
    fresh = [a for a in fresh if a in allowed]
    if fresh:
        preference = ((0, 1, 2), (1, 2, 0), (2, 1, 0))[band]
        return next(a for a in preference if a in fresh), epsilon
    log_total = np.log(total)
    values = [(q[a] + S.UCB_WEIGHT * np.sqrt(log_total / n[a]), -a) for a in allowed]
    return -max(values)[1], epsilon


def _online_reward(truth: int, action: int, load: float, score: float) -> float:
    if truth == 1:
        return (
            S.REWARD_MISSED_THREAT * (1.0 + score),
            S.REWARD_MONITORED_THREAT * (1.0 - load),
            S.REWARD_ESCALATED_THREAT * (1.0 + score),
        )[action]
    return (
        S.REWARD_DISMISSED_BENIGN,
        S.REWARD_MONITORED_BENIGN,
        S.REWARD_ESCALATED_BENIGN * (1.0 + load),
    )[action]
