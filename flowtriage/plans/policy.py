"""Triage policy queries: lookup, decision, reward, fold, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.operators import policy
from flowtriage.operators.ordered import threat_density
from flowtriage.plans.aggregates import DENSITY_SQL, LEARNED_SQL, learned_policy
from flowtriage.plans.tables import PORT_CLASS_SQL, decisions, reward_sql
from flowtriage.plans.windows import BLOCK
from flowtriage.sources.workspace import durable

# A deterministic policy that reaches every branch of the decision rule; the
# same text runs in both engines over the 18,000 cells.
_M = "((tb*7 + lb*5 + db*3 + pb*2) % 6)"
_J = "((tb + lb + pb) % 3)"
_VISITS = (
    f"CAST(CASE {_M} WHEN 0 THEN 0 WHEN 1 THEN CASE WHEN action = {_J} THEN 4 ELSE 0 END "
    f"WHEN 2 THEN CASE WHEN action = {_J} THEN 0 ELSE 4 END WHEN 3 THEN 1 ELSE 1 + (tb + action) % 4 END AS BIGINT)"
)
_VALUE = f"CASE {_M} WHEN 3 THEN 7e0 ELSE ((tb*13 + lb*3 + db + pb*5 + action*17) % 101) - 50e0 END"
_Q = f"CASE WHEN visits = 0 THEN 0e0 ELSE {_VALUE} END"


def fixture_policy(spark):
    cells = spark.range(18_000).selectExpr(
        "CAST(id DIV 900 AS INT) AS tb", "CAST(id DIV 45 % 20 AS INT) AS lb", "CAST(id DIV 9 % 5 AS INT) AS db",
        "CAST(id DIV 3 % 3 AS INT) AS pb", "CAST(id % 3 AS INT) AS action",
    )
    return cells.selectExpr("*", f"{_VISITS} AS visits").selectExpr("*", f"{_Q} AS q")


def dense(spark, folder):
    return threat_density(decisions(spark, folder), "threat_score", block_rows=BLOCK, dense=True)


def _decided(spark, folder):
    """Logged flows re-decided by the fixture policy."""
    df = dense(spark, folder).withColumnRenamed("action", "logged_action")
    return policy.decide(df, fixture_policy(spark), "threat_score", F.col("analyst_load"), base_steps=500)


def j02_policy_lookup(spark, folder):
    return _decided(spark, folder).select("step", "q0", "q1", "q2", "n0", "n1", "n2")


def b02_cold_start(spark, folder):
    cold = _decided(spark, folder).filter(F.col("state_visits") == 0)
    return cold.select("step", policy.cold_start_action(F.col("threat_score")).alias("action"))


def _shown(name: str):
    return F.when(F.abs(name) == float("inf"), F.signum(name) * 1e9).otherwise(F.round(name, 4)).alias(name)


def b03_ucb_values(spark, folder):
    df = _decided(spark, folder)
    raw = policy.upper_bounds(F.col("step") + 500)
    return df.withColumns({f"u{a}": raw[a] for a in range(3)}).select("step", *[_shown(f"u{a}") for a in range(3)])


def b04_safety_constraint(spark, folder):
    return _decided(spark, folder).select("step", _shown("ucb0"))


def b05_tie_break(spark, folder):
    warm = _decided(spark, folder).filter(F.col("state_visits") > 0)
    return warm.select("step", "action")


def b08_policy_update(spark, folder):
    folded = learned_policy(spark, folder)
    return folded.select(*policy.CELL, F.round("q", 3).alias("q"), "visits")


def b09_policy_migration(spark, folder):
    """A policy learned without port classes, copied to each of them."""
    placed = dense(spark, folder)
    state = triage.state_columns(F.col("threat_score"), F.col("analyst_load"), F.col("density_after"), F.lit(0))
    updates = durable(placed.withColumns(state).select(*policy.CELL, "reward", "step"))
    plain = policy.fold_updates(updates, policy.empty_policy(spark), block_rows=BLOCK).drop("pb")
    return policy.migrate_without_ports(plain).select(*policy.CELL, F.round("q", 3).alias("q"), "visits")


def b10_frozen_decision(spark, folder):
    return _decided(spark, folder).select("step", "tb", "lb", "db", "pb", "action", F.round("epsilon", 6).alias("epsilon"))


def b11_online_replay(spark, folder):
    replayed = policy.replay_online(dense(spark, folder), policy.empty_policy(spark))
    return replayed.select("step", "tb", "lb", "pb", "action", F.round("reward", 4).alias("reward"), F.round("q", 3).alias("q"), "visits")


QUERIES = {f.__name__: f for f in (
    j02_policy_lookup, b02_cold_start, b03_ucb_values, b04_safety_constraint, b05_tie_break,
    b08_policy_update, b09_policy_migration, b10_frozen_decision, b11_online_replay,
)}

POLICY_SQL = f"""
cells AS (SELECT CAST(id // 900 AS INT) AS tb, CAST(id // 45 % 20 AS INT) AS lb, CAST(id // 9 % 5 AS INT) AS db,
    CAST(id // 3 % 3 AS INT) AS pb, CAST(id % 3 AS INT) AS action FROM range(18000) t(id)),
visited AS (SELECT *, {_VISITS} AS visits FROM cells),
policy AS (SELECT *, {_Q} AS q FROM visited),
states AS (SELECT tb, lb, db, pb, {', '.join(f'max(q) FILTER (WHERE action = {a}) AS q{a}, max(visits) FILTER (WHERE action = {a}) AS n{a}' for a in range(3))}
  FROM policy GROUP BY tb, lb, db, pb)"""
_UCB = ", ".join(
    f"CASE WHEN n{a} = 0 THEN CAST('Infinity' AS DOUBLE) ELSE q{a} + sqrt(ln(step + 500) / greatest(n{a}, 1)) END AS u{a}" for a in range(3)
)
_COLD = "(CASE WHEN threat_score >= 0.7e0 THEN 2 WHEN threat_score >= 0.3e0 THEN 1 ELSE 0 END)"
_INF = "CAST('Infinity' AS DOUBLE)"
DECIDED_SQL = DENSITY_SQL + ", " + POLICY_SQL + f""",
located AS (SELECT step, threat_score, analyst_load, CAST(floor(least(19e0, threat_score*20)) AS INT) AS tb,
    CAST(floor(least(19e0, analyst_load*20)) AS INT) AS lb, CAST(floor(least(4e0, density_before*5)) AS INT) AS db,
    {PORT_CLASS_SQL} AS pb FROM dense),
known AS (SELECT * FROM located JOIN states USING (tb, lb, db, pb)),
bounded AS (SELECT *, {_UCB}, n0 + n1 + n2 AS state_visits FROM known),
guarded AS (SELECT *, CASE WHEN threat_score >= 0.7e0 OR (threat_score >= 0.3e0 AND (n1 = 0 OR n2 = 0)) THEN -{_INF} ELSE u0 END AS g0 FROM bounded),
ranked AS (SELECT *, CAST(g0 = {_INF} AS INT) + CAST(u1 = {_INF} AS INT) + CAST(u2 = {_INF} AS INT) AS unvisited FROM guarded),
decided AS (SELECT *, CASE WHEN state_visits = 0 THEN {_COLD}
    WHEN unvisited > 1 AND threat_score >= 0.7e0 THEN CASE WHEN u2 = {_INF} THEN 2 ELSE 1 END
    WHEN unvisited > 1 AND threat_score >= 0.3e0 THEN CASE WHEN u1 = {_INF} THEN 1 ELSE 2 END
    WHEN unvisited > 1 THEN CASE WHEN g0 = {_INF} THEN 0 ELSE 1 END
    WHEN g0 >= u1 AND g0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END AS act FROM ranked)"""

# The online run as a recursion over the n-th flow of every (tb, lb, pb); the
# 15 cells of a key (density x action) travel as two lists.
_CHOOSE = f"""CASE WHEN n0 + n1 + n2 = 0 THEN {_COLD}
  WHEN unvisited > 1 AND threat_score >= 0.7e0 THEN CASE WHEN u2 = {_INF} THEN 2 ELSE 1 END
  WHEN unvisited > 1 AND threat_score >= 0.3e0 THEN CASE WHEN u1 = {_INF} THEN 1 ELSE 2 END
  WHEN unvisited > 1 THEN CASE WHEN g0 = {_INF} THEN 0 ELSE 1 END
  WHEN g0 >= u1 AND g0 >= u2 THEN 0 WHEN u1 >= u2 THEN 1 ELSE 2 END"""
_ZEROS = ", ".join(["0"] * 15)
REPLAY_SQL = DENSITY_SQL.replace("WITH events_with_k", "WITH RECURSIVE events_with_k") + f""",
queued AS (SELECT *, row_number() OVER (PARTITION BY tb, lb, pb ORDER BY step) AS i FROM (
  SELECT step, threat_score, analyst_load, y, CAST(floor(least(19e0, threat_score*20)) AS INT) AS tb,
    CAST(floor(least(19e0, analyst_load*20)) AS INT) AS lb, CAST(floor(least(4e0, density_before*5)) AS INT) AS db,
    CAST(floor(least(4e0, density_after*5)) AS INT) AS db2, {PORT_CLASS_SQL} AS pb FROM dense)),
run AS (
  SELECT tb, lb, pb, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS step, CAST(0 AS INT) AS action, 0e0 AS reward,
    CAST(0 AS DOUBLE) AS newest, CAST(0 AS BIGINT) AS visits,
    CAST([{_ZEROS}] AS DOUBLE[]) AS qs, CAST([{_ZEROS}] AS BIGINT[]) AS ns
  FROM (SELECT DISTINCT tb, lb, pb FROM queued)
  UNION ALL
  SELECT tb, lb, pb, i, step, act, rw, newest, seen,
    [CASE WHEN x = cell THEN newest ELSE qs[x] END FOR x IN range(1, 16)],
    [CASE WHEN x = cell THEN seen ELSE ns[x] END FOR x IN range(1, 16)]
  FROM (SELECT *, qs[cell] + 0.15e0 / (1 + 0.001e0 * seen) * (rw - qs[cell]) AS newest FROM (
    SELECT *, ns[cell] + 1 AS seen FROM (
      SELECT *, db2 * 3 + act + 1 AS cell, {reward_sql('y', 'act', 'analyst_load', 'threat_score')} AS rw FROM (
        SELECT *, CAST({_CHOOSE} AS INT) AS act FROM (
          SELECT *, CAST(g0 = {_INF} AS INT) + CAST(u1 = {_INF} AS INT) + CAST(u2 = {_INF} AS INT) AS unvisited FROM (
            SELECT *, CASE WHEN threat_score >= 0.7e0 OR (threat_score >= 0.3e0 AND (n1 = 0 OR n2 = 0)) THEN -{_INF} ELSE u0 END AS g0 FROM (
              SELECT *, {_UCB.replace('step + 500', 'step')} FROM (
                SELECT o.*, qs, ns, qs[db*3+1] AS q0, qs[db*3+2] AS q1, qs[db*3+3] AS q2,
                  ns[db*3+1] AS n0, ns[db*3+2] AS n1, ns[db*3+3] AS n2
                FROM run r JOIN queued o ON o.tb = r.tb AND o.lb = r.lb AND o.pb = r.pb AND o.i = r.i + 1))))))))
)"""


def _shown_sql(expr: str, name: str) -> str:
    return f"CASE WHEN isinf({expr}) THEN sign({expr}) * 1e9 ELSE round({expr}, 4) END AS {name}"


ORACLES = {
    "j02_policy_lookup": DECIDED_SQL + "SELECT step, q0, q1, q2, n0, n1, n2 FROM known",
    "b02_cold_start": DECIDED_SQL + f"SELECT step, {_COLD} AS action FROM bounded WHERE state_visits = 0",
    "b03_ucb_values": DECIDED_SQL + f"SELECT step, {', '.join(_shown_sql(f'u{a}', f'u{a}') for a in range(3))} FROM bounded",
    "b04_safety_constraint": DECIDED_SQL + f"SELECT step, {_shown_sql('g0', 'ucb0')} FROM guarded",
    "b05_tie_break": DECIDED_SQL + "SELECT step, act AS action FROM decided WHERE state_visits > 0",
    "b08_policy_update": LEARNED_SQL + "SELECT tb, lb, db, pb, action, round(q, 3) AS q, visits FROM learned",
    "b09_policy_migration": LEARNED_SQL.replace(f"{PORT_CLASS_SQL} AS pb FROM dense", "0 AS pb FROM dense")
    + "SELECT tb, lb, db, p.c AS pb, action, round(q, 3) AS q, visits FROM learned, (VALUES (0), (1), (2)) p(c)",
    "b11_online_replay": REPLAY_SQL + """
SELECT step, tb, lb, pb, action, round(reward, 4) AS reward, round(newest, 3) AS q, visits FROM run WHERE i > 0""",
    "b10_frozen_decision": DECIDED_SQL + """
SELECT step, tb, lb, db, pb, act AS action,
  round(CASE WHEN state_visits = 0 THEN 1e0 ELSE greatest(0.01e0, 1 / (1 + 0.001e0 * state_visits)) END, 6) AS epsilon FROM decided""",
}
