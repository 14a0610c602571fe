"""Streaming jobs run to completion over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage.plans.aggregates import LEARNED_SQL
from flowtriage.plans.policy import _COLD
from flowtriage.plans.projections import SRC_PORT_SQL, _MASKS
from flowtriage.plans.tables import (
    FLOWS_SQL, LEVEL_SQL, Y_SQL, confusion_sql, events_as_flows, flows, reward_sql, table, with_decisions,
)
from flowtriage.plans.windows import BLOCK, DAY_SECONDS, WINDOW_SQL, _ALL, _COUNTS_SQL, _EXPR, _ROUNDED
from flowtriage.sources.sinks import load_policy
from flowtriage.sources.workspace import new_folder
from flowtriage import schema as S
from flowtriage.streaming import jobs, restore


def flow_stream(spark, folder):
    schema = table(spark, folder, "events").schema
    return events_as_flows(jobs.file_stream(spark, folder, schema, "events.parquet"))


def _triaged(source):
    return jobs.triage_flows(source.withColumn("src_port", F.expr(SRC_PORT_SQL)), packet_rate=None)


def r01_stream_triage(spark, folder):
    done = jobs.run_to_table(_triaged(flow_stream(spark, folder)).select("flow_id", "route", "action", "level", "outcome"))
    return done


def r02_running_metrics(spark, folder):
    return jobs.latest_metrics(_triaged(flow_stream(spark, folder)))


def _batched_behaviour(spark, stream, seconds):
    batches = jobs.BehaviourBatches(new_folder(spark, "behaviour"), seconds, block_rows=BLOCK)
    jobs.run_batches(stream, batches)
    return spark.read.option("basePath", batches.results_folder).parquet(batches.results_folder)


def r03_stateful_behaviour(spark, folder):
    done = _batched_behaviour(spark, flow_stream(spark, folder), DAY_SECONDS)
    return done.select("flow_id", *[F.round(c, _ROUNDED.get(c, 8)).alias(c) for c in _ALL])


def r04_online_learning(spark, folder):
    """Policy learned from the stream, starting empty."""
    stream = with_decisions(flow_stream(spark, folder)).drop("action", "reward")
    learner = jobs.OnlineLearner(new_folder(spark, "learner"))
    jobs.run_batches(stream, learner)
    learned, _ = load_policy(spark, learner.policy_folder)
    return learned.select("tb", "lb", "db", "pb", "action", F.round("q", 3).alias("q"), "visits")


def r05_progress_snapshots(spark, folder):
    root = new_folder(spark, "progress")
    jobs.run_batches(with_decisions(flow_stream(spark, folder)), jobs.ProgressWriter(root, every=1_000, block_rows=BLOCK))
    shots = spark.read.option("basePath", f"{root}/snapshots").parquet(f"{root}/snapshots")
    return shots.select("step", F.round("cumulative_reward", 0).alias("cumulative_reward"), *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")])


def r06_header_and_summary(spark, folder):
    triaged = _triaged(flows(spark, folder))
    header = jobs.stream_header(triaged).withColumn("kind", F.lit("header"))
    done = jobs.stream_summary(triaged).withColumn("kind", F.lit("done"))
    return header.unionByName(done, allowMissingColumns=True)


def r07_dead_letters(spark, folder):
    messy = flow_stream(spark, folder).withColumn(
        "raw", F.expr("CASE k % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE CAST(k AS VARCHAR(10)) END")
    )
    usable, broken = jobs.split_valid(messy.select("flow_id", "raw"), ["raw"])
    good, bad = jobs.run_to_table(usable), jobs.run_to_table(broken)
    return good.agg(F.count("*").alias("n"), F.sum("flow_id").alias("ids")).withColumn("part", F.lit("usable")).unionByName(
        bad.agg(F.count("*").alias("n"), F.sum("flow_id").alias("ids")).withColumn("part", F.lit("dead"))
    )


_MESSY = "CASE k % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE CAST(k AS VARCHAR(10)) END"


def r07_one_pass(spark, folder):
    """The same split from one read of each micro-batch: the events in four parts, one file a batch."""
    events = table(spark, folder, "events")
    staged = new_folder(spark, "events-parts")
    for k, (low, high) in enumerate(restore.step_ranges(events, "event_id", 4)):
        events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).write.parquet(f"{staged}/part-{k}")
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{staged}/*")
    messy = events_as_flows(raw).withColumn("raw", F.expr(_MESSY)).select("flow_id", "raw")
    letters = jobs.DeadLetters(new_folder(spark, "letters"), ["raw"])
    jobs.run_batches(messy, letters)
    good, bad = letters.read(spark, messy.schema)
    totals = [F.count("*").alias("n"), F.sum("flow_id").alias("ids")]
    return good.agg(*totals).withColumn("part", F.lit("usable")).unionByName(bad.agg(*totals).withColumn("part", F.lit("dead")))


def r08_event_time_windows(spark, folder):
    done = jobs.all_windows(flow_stream(spark, folder), flows(spark, folder), "1 hour", "24 hours", "12 hours")
    return done.select("src_ip", F.unix_seconds("window_start").alias("start"), "flows", "short", "ports", F.round("avg_duration", 5).alias("avg_duration"))


def r09_state_reset(spark, folder):
    """A flow with k = 0 resets its source; later flows start a new window."""
    stream = flow_stream(spark, folder).withColumn("control", F.when(F.col("k") == 0, "reset"))
    return _batched_behaviour(spark, stream, 10 * DAY_SECONDS).select("flow_id", "beh_flow_count_window")


def _keyed(spark, folder, seconds, max_flows=S.BEHAVIOUR_MAX_FLOWS, control=False):
    """Keyed RocksDB state over four parts of the events: a restart after each, a hand-over to a fresh query after two."""
    events = table(spark, folder, "events")

    def prepare(raw):
        found = events_as_flows(raw)
        return found.withColumn("control", F.when(F.col("k") == 0, "reset")) if control else found

    return restore.behaviour_over_parts(events, prepare, "event_id", window_seconds=seconds, max_flows=max_flows)


def r03_keyed_state(spark, folder):
    found, _, _ = _keyed(spark, folder, DAY_SECONDS)
    return found.select("flow_id", *[F.round(c, _ROUNDED.get(c, 8)).alias(c) for c in _ALL])


def r09_keyed_reset(spark, folder):
    found, _, _ = _keyed(spark, folder, 10 * DAY_SECONDS, control=True)
    return found.select("flow_id", "beh_flow_count_window")


def s11_state_restored(spark, folder):
    """The last five flows of every source, read back from the state the streams left."""
    _, first, second = _keyed(spark, folder, DAY_SECONDS, max_flows=5)
    tail = restore.last_state(spark, first, second)
    return tail.select(F.col("src_key").alias("src_ip"), "us", F.col("port").alias("dst_port"))


QUERIES = {f.__name__: f for f in (
    r01_stream_triage, r02_running_metrics, r03_stateful_behaviour, r04_online_learning, r05_progress_snapshots,
    r06_header_and_summary, r07_dead_letters, r08_event_time_windows, r09_state_reset,
    r03_keyed_state, r09_keyed_reset, s11_state_restored, r07_one_pass,
)}

_TRIAGED_SQL = FLOWS_SQL + f""",
routed AS (SELECT *, CASE WHEN auth THEN 'auth' WHEN web THEN 'web' ELSE 'main' END AS route, {Y_SQL} AS y FROM ({_MASKS})),
triaged AS (SELECT *, CASE WHEN threat_score >= 0.75e0 THEN 2
  WHEN threat_score >= (CASE WHEN route <> 'main' THEN 0.30e0 ELSE 0.35e0 END) THEN 1 ELSE 0 END AS action FROM routed)
"""

ORACLES = {
    "r01_stream_triage": _TRIAGED_SQL + f"""
SELECT flow_id, route, action, {LEVEL_SQL} AS level, CASE WHEN y = 1 AND action >= 1 THEN 'TP' WHEN action >= 1 THEN 'FP'
  WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM triaged""",
    "r02_running_metrics": _TRIAGED_SQL + f"""
SELECT tp, fp, fn, tn, CAST(round_even(precision, 4) AS DOUBLE) AS precision, CAST(round_even(recall, 4) AS DOUBLE) AS recall,
  CAST(round_even(2*precision*recall/greatest(precision+recall, 1e-9), 4) AS DOUBLE) AS f1, CAST(round_even(fpr, 4) AS DOUBLE) AS fpr
FROM (SELECT *, CAST(tp AS DOUBLE)/greatest(tp+fp,1) AS precision, CAST(tp AS DOUBLE)/greatest(tp+fn,1) AS recall,
  CAST(fp AS DOUBLE)/greatest(fp+tn,1) AS fpr FROM (SELECT {confusion_sql('action >= 1')} FROM triaged))""",
    "r03_stateful_behaviour": WINDOW_SQL + "SELECT flow_id, " + ", ".join(f"round({_EXPR[c]}, {_ROUNDED.get(c, 8)}) AS {c}" for c in _ALL) + " FROM scored",
    # From an empty policy every decision is a cold start; then one fold.
    "r04_online_learning": LEARNED_SQL.replace(
        "placed AS (SELECT step, reward, action,",
        f"placed AS (SELECT step, {reward_sql('y', _COLD, 'analyst_load', 'threat_score')} AS reward, {_COLD} AS action,",
    ) + "SELECT tb, lb, db, pb, action, round(q, 3) AS q, visits FROM learned",
    "r05_progress_snapshots": _COUNTS_SQL + """
SELECT step, round(cumulative_reward, 0) AS cumulative_reward, CAST(round_even(precision, 4) AS DOUBLE) AS precision,
  CAST(round_even(recall, 4) AS DOUBLE) AS recall, CAST(round_even(f1, 4) AS DOUBLE) AS f1 FROM series WHERE step % 1000 = 0""",
    "r06_header_and_summary": _TRIAGED_SQL + f""",
counts AS (SELECT {confusion_sql('action >= 1')} FROM triaged),
rates AS (SELECT *, CAST(tp AS DOUBLE)/greatest(tp+fp,1) AS precision, CAST(tp AS DOUBLE)/greatest(tp+fn,1) AS recall,
  CAST(fp AS DOUBLE)/greatest(fp+tn,1) AS fpr FROM counts)
SELECT 'header' AS kind, count(*) AS total, count(*) FILTER (WHERE {Y_SQL} = 1) AS n_attacks, count(*) FILTER (WHERE {Y_SQL} = 0) AS n_benign,
  NULL::BIGINT AS tp, NULL::BIGINT AS fp, NULL::BIGINT AS fn, NULL::BIGINT AS tn, NULL::DOUBLE AS precision, NULL::DOUBLE AS recall, NULL::DOUBLE AS f1, NULL::DOUBLE AS fpr FROM flows
UNION ALL SELECT 'done', tp + fp + fn + tn, NULL, NULL, tp, fp, fn, tn, CAST(round_even(precision, 4) AS DOUBLE), CAST(round_even(recall, 4) AS DOUBLE),
  CAST(round_even(2*precision*recall/greatest(precision+recall, 1e-9), 4) AS DOUBLE), CAST(round_even(fpr, 4) AS DOUBLE) FROM rates""",
    "r07_dead_letters": FLOWS_SQL + """
SELECT CASE WHEN k % 6 IN (0, 1, 2) THEN 'dead' ELSE 'usable' END AS part, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS ids FROM flows GROUP BY 1""",
    "r08_event_time_windows": FLOWS_SQL + """,
spread AS (SELECT src_ip, flow_duration, dst_port, CAST(epoch(ts) AS BIGINT) // 43200 * 43200 - s.back AS start
  FROM flows, (VALUES (0), (43200)) s(back))
SELECT src_ip, CAST(start AS BIGINT) AS start, count(*) AS flows, count(*) FILTER (WHERE flow_duration < 1000) AS short,
  count(DISTINCT dst_port) AS ports, round(avg(flow_duration), 5) AS avg_duration
FROM spread GROUP BY 1, 2""",
    "r09_state_reset": FLOWS_SQL + """,
spells AS (SELECT *, count(*) FILTER (WHERE k = 0) OVER (PARTITION BY src_ip ORDER BY step ROWS UNBOUNDED PRECEDING) AS spell FROM flows),
counted AS (SELECT flow_id, k, count(*) FILTER (WHERE k > 0) OVER (PARTITION BY src_ip, spell ORDER BY ts RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW) AS c,
  count(*) FILTER (WHERE k > 0) OVER (PARTITION BY src_ip, spell ORDER BY step ROWS UNBOUNDED PRECEDING) AS r FROM spells)
SELECT flow_id, CAST(least(c, r, 200) AS DOUBLE) AS beh_flow_count_window FROM counted WHERE k > 0""",
}

ORACLES["r03_keyed_state"] = ORACLES["r03_stateful_behaviour"]
ORACLES["r07_one_pass"] = ORACLES["r07_dead_letters"]
ORACLES["r09_keyed_reset"] = ORACLES["r09_state_reset"]
ORACLES["s11_state_restored"] = FLOWS_SQL + """,
keyed AS (SELECT *, coalesce(src_ip, 'row_' || CAST(CAST(dst_port AS INT) AS VARCHAR), 'row_') AS src_key FROM flows)
SELECT src_key AS src_ip, epoch_us(ts) AS us, CAST(dst_port AS INT) AS dst_port
FROM (SELECT *, row_number() OVER (PARTITION BY src_key ORDER BY step DESC) AS rn FROM keyed) WHERE rn <= 5"""
