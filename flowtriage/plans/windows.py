"""Behaviour windows and globally ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.functions.flow import phase_load
from flowtriage.operators import behaviour, ordered, policy
from flowtriage.operators.behaviour import behaviour_features
from flowtriage.plans.tables import DECISIONS_SQL, FLOWS_SQL, decisions, flows, table

DAY_SECONDS = 24 * 3600
BLOCK = 4_096  # small enough that the test tables span several blocks

_ROUNDED = {
    "beh_conn_rate_per_min": 8, "beh_short_flow_ratio": 8, "beh_unique_dst_ports": 1, "beh_pkt_size_std": 6,
    "beh_flow_count_window": 1, "beh_large_payload_ratio": 8, "beh_avg_duration": 5,
    "behaviour_score": 10,
}


def _windowed(spark, folder, columns, seconds=DAY_SECONDS, cap=S.BEHAVIOUR_MAX_FLOWS, mode="event_time"):
    df = behaviour_features(flows(spark, folder), window_seconds=seconds, max_flows=cap, block_rows=BLOCK, mode=mode, keep=["flow_id"])
    return df.select("flow_id", *[F.round(c, _ROUNDED.get(c, 8)).alias(c) for c in columns])


def w01_shorter_window(spark, folder):
    """Three days, at most five flows: both limits take effect."""
    return _windowed(spark, folder, [*S.BEHAVIOUR_COLUMNS, "behaviour_score"], seconds=72 * 3600, cap=5)


def w01_arrival_window(spark, folder):
    """The whole table arriving at once: only the row cap applies."""
    return _windowed(spark, folder, [*S.BEHAVIOUR_COLUMNS, "behaviour_score"], cap=20, mode="arrival")


def w01_missing_source(spark, folder):
    """A quarter of the flows lack a source: they are keyed by port, and none is lost."""
    df = flows(spark, folder).withColumn("src_ip", F.when(F.col("k") % 4 > 0, F.col("src_ip")))
    found = behaviour_features(df, window_seconds=DAY_SECONDS, block_rows=BLOCK, keep=["flow_id"])
    return found.select("flow_id", *[F.round(c, _ROUNDED.get(c, 8)).alias(c) for c in _ALL])


def w02_connection_rate(spark, folder):
    return _windowed(spark, folder, ["beh_conn_rate_per_min"])


def w03_short_flow_ratio(spark, folder):
    return _windowed(spark, folder, ["beh_short_flow_ratio"])


def w04_unique_ports(spark, folder):
    return _windowed(spark, folder, ["beh_unique_dst_ports"])


def w05_packet_size_std(spark, folder):
    return _windowed(spark, folder, ["beh_pkt_size_std"])


def w06_flow_count(spark, folder):
    return _windowed(spark, folder, ["beh_flow_count_window"])


def w07_large_payload_ratio(spark, folder):
    return _windowed(spark, folder, ["beh_large_payload_ratio"])


def w08_average_duration(spark, folder):
    return _windowed(spark, folder, ["beh_avg_duration"])


def w09_behaviour_score(spark, folder):
    return _windowed(spark, folder, ["behaviour_score"])


def w10_behaviour_vector(spark, folder):
    df = behaviour_features(flows(spark, folder), window_seconds=DAY_SECONDS, block_rows=BLOCK, keep=["flow_id"])
    vector = behaviour.behaviour_vector()
    return df.select("flow_id", F.size(vector).alias("width"),
                     *[F.round(vector[i].cast("double"), 2).alias(f"v{i}") for i in (1, 2, 4, 5)])


def w11_threat_density(spark, folder):
    df = ordered.threat_density(flows(spark, folder), "threat_score", block_rows=BLOCK, dense=True)
    return df.select("step", F.round("density_before", 8).alias("density_before"), F.round("density_after", 8).alias("density_after"))


def w11_gapped_density(spark, folder):
    """After a filter the steps have gaps; the window still holds the last 100 rows."""
    rest = flows(spark, folder).filter(F.col("k") % 10 > 0)
    df = ordered.threat_density(rest, "threat_score", block_rows=BLOCK)
    return df.select("step", F.round("density_before", 8).alias("density_before"), F.round("density_after", 8).alias("density_after"))


def w12_cumulative_reward(spark, folder):
    df = ordered.running_sums(decisions(spark, folder), {"cumulative_reward": F.col("reward")}, block_rows=BLOCK)
    return df.select("step", F.round("cumulative_reward", 2).alias("cumulative_reward"))


def _series(spark, folder):
    action = F.col("action")
    return ordered.running_confusion(
        decisions(spark, folder), "y", action >= 1, action == 2, block_rows=BLOCK,
        extra={"cumulative_reward": F.col("reward")},
    )


def w13_running_metrics(spark, folder):
    return _series(spark, folder).select(
        "step", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "fpr")]
    )


def w14_dense_step(spark, folder):
    items = table(spark, folder, "orders")
    return ordered.dense_step(items.select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_orderkey", "step")


def w14_dense_step_by_time(spark, folder):
    return ordered.dense_step(flows(spark, folder).select("flow_id", "ts"), "ts").select("flow_id", "step")


def w15_load_phase(spark, folder):
    df = flows(spark, folder).withColumn("file", F.concat(F.lit("part-0"), F.col("chunk").cast("string")))
    return ordered.load_phases(df.select("flow_id", "file"), "file").select("flow_id", "file", "analyst_load")


def w15_load_phase_by_chunk(spark, folder):
    """The load by chunk index; flows without a chunk form the last phase."""
    df = flows(spark, folder).withColumn("chunk", F.when(F.col("k") % 7 > 0, F.col("chunk")))
    return ordered.load_phases(df, "chunk").select("flow_id", "phase", "chunk", "analyst_load")


def w16_learning_phase(spark, folder):
    """The first steps of the series; the step limit is the feature."""
    return w13_running_metrics(spark, folder).filter(F.col("step") <= 50_000)


def w17_progress_snapshots(spark, folder):
    snapshots = _series(spark, folder).filter(F.col("step") % 1_000 == 0)
    return snapshots.select(
        "step", F.round("cumulative_reward", 0).alias("cumulative_reward"),
        *[F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")],
    )


def w18_exploration(spark, folder):
    visits = behaviour.with_source_rank(flows(spark, folder), "src_ip", "step").withColumn(
        "visits", (F.col("src_rank") - 1) * 100
    )
    return visits.select("flow_id", F.round(triage.exploration(F.col("visits")), 6).alias("epsilon"))


QUERIES = {f.__name__: f for f in (
    w01_shorter_window, w01_arrival_window, w01_missing_source, w02_connection_rate, w03_short_flow_ratio, w04_unique_ports,
    w05_packet_size_std, w06_flow_count, w07_large_payload_ratio, w08_average_duration, w09_behaviour_score,
    w10_behaviour_vector, w11_threat_density, w11_gapped_density, w12_cumulative_reward, w13_running_metrics, w14_dense_step,
    w14_dense_step_by_time, w15_load_phase, w15_load_phase_by_chunk, w16_learning_phase, w17_progress_snapshots, w18_exploration,
)}


def _stats(frame: str) -> str:
    return f"""count(*) OVER {frame} AS n, min(ts) OVER {frame} AS first,
    count(*) FILTER (WHERE flow_duration < 1000) OVER {frame} AS short,
    count(*) FILTER (WHERE totlen_fwd_pkts > 10000) OVER {frame} AS large,
    count(DISTINCT dst_port) OVER {frame} AS ports,
    avg(flow_duration) OVER {frame} AS dur, stddev_pop(pkt_size_avg) OVER {frame} AS size_std"""


_SCORED = """
measured AS (SELECT *, n / greatest(1e0, (epoch_us(ts) - epoch_us(first)) / 1e6) * 60 AS rate FROM suffix),
scored AS (SELECT *, least(1e0, greatest(0e0, 0.35e0*least(1e0, rate/300) + 0.20e0*short/n + 0.15e0*least(1e0, ports/20e0)
    + 0.20e0*large/n + 0.10e0*least(1e0, dur/120000))) AS score FROM measured)
"""
_TIMED = "(PARTITION BY src_ip ORDER BY ts RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW)"
_CAPPED = "(PARTITION BY src_ip ORDER BY ts ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)"

WINDOW_SQL = FLOWS_SQL + f", suffix AS (SELECT *, {_stats(_TIMED.format(hours=24))} FROM flows), {_SCORED}"
_KEYLESS_SQL = FLOWS_SQL + f""",
keyed AS (SELECT * REPLACE (CASE WHEN k % 4 > 0 THEN src_ip ELSE 'row_' || CAST(dst_port AS VARCHAR(9)) END AS src_ip) FROM flows),
timed AS (SELECT *, {_stats(_TIMED.format(hours=24))} FROM keyed),
capped AS (SELECT flow_id, {_stats(_CAPPED.format(rows=199))} FROM keyed),
suffix AS (
  SELECT flow_id, ts, n, first, short, large, ports, dur, size_std FROM timed WHERE n < 200
  UNION ALL SELECT c.flow_id, t.ts, c.n, c.first, c.short, c.large, c.ports, c.dur, c.size_std
  FROM capped c JOIN timed t USING (flow_id) WHERE t.n >= 200), {_SCORED}"""
_SHORTER_SQL = FLOWS_SQL + f""",
timed AS (SELECT *, {_stats(_TIMED.format(hours=72))} FROM flows),
capped AS (SELECT flow_id, {_stats(_CAPPED.format(rows=4))} FROM flows),
suffix AS (
  SELECT flow_id, ts, n, first, short, large, ports, dur, size_std FROM timed WHERE n < 5
  UNION ALL SELECT c.flow_id, t.ts, c.n, c.first, c.short, c.large, c.ports, c.dur, c.size_std
  FROM capped c JOIN timed t USING (flow_id) WHERE t.n >= 5), {_SCORED}"""
_ARRIVAL_SQL = FLOWS_SQL + f""",
suffix AS (SELECT * REPLACE (ts AS first) FROM (SELECT *, {_stats(_CAPPED.format(rows=19))} FROM flows)), {_SCORED}"""

_EXPR = {
    "beh_conn_rate_per_min": "rate", "beh_short_flow_ratio": "CAST(short AS DOUBLE)/n", "beh_unique_dst_ports": "CAST(ports AS DOUBLE)",
    "beh_pkt_size_std": "size_std", "beh_flow_count_window": "CAST(n AS DOUBLE)",
    "beh_large_payload_ratio": "CAST(large AS DOUBLE)/n", "beh_avg_duration": "dur", "behaviour_score": "score",
}


def _select(columns) -> str:
    return "SELECT flow_id, " + ", ".join(f"round({_EXPR[c]}, {_ROUNDED.get(c, 8)}) AS {c}" for c in columns) + " FROM scored"


_ALL = [*S.BEHAVIOUR_COLUMNS, "behaviour_score"]
_RUNNING = "OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_COUNTS_SQL = DECISIONS_SQL + f"""
, counts AS (SELECT step, count(*) FILTER (WHERE y=1 AND action>=1) {_RUNNING} AS tp, count(*) FILTER (WHERE y=0 AND action=2) {_RUNNING} AS fp,
  count(*) FILTER (WHERE y=1 AND action=0) {_RUNNING} AS fn, count(*) FILTER (WHERE y=0 AND action<2) {_RUNNING} AS tn,
  sum(reward) {_RUNNING} AS cumulative_reward FROM decisions),
rates AS (SELECT *, CAST(tp AS DOUBLE)/greatest(tp+fp,1) AS precision, CAST(tp AS DOUBLE)/greatest(tp+fn,1) AS recall,
  CAST(fp AS DOUBLE)/greatest(fp+tn,1) AS fpr FROM counts),
series AS (SELECT *, 2*precision*recall/greatest(precision+recall, 1e-9) AS f1 FROM rates)
"""
_W13 = "SELECT step, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(fpr, 6) AS fpr FROM series"

ORACLES = {
    "w01_shorter_window": _SHORTER_SQL + _select(_ALL),
    "w01_arrival_window": _ARRIVAL_SQL + _select(_ALL),
    "w01_missing_source": _KEYLESS_SQL + _select(_ALL),
    "w02_connection_rate": WINDOW_SQL + _select(["beh_conn_rate_per_min"]),
    "w03_short_flow_ratio": WINDOW_SQL + _select(["beh_short_flow_ratio"]),
    "w04_unique_ports": WINDOW_SQL + _select(["beh_unique_dst_ports"]),
    "w05_packet_size_std": WINDOW_SQL + _select(["beh_pkt_size_std"]),
    "w06_flow_count": WINDOW_SQL + _select(["beh_flow_count_window"]),
    "w07_large_payload_ratio": WINDOW_SQL + _select(["beh_large_payload_ratio"]),
    "w08_average_duration": WINDOW_SQL + _select(["beh_avg_duration"]),
    "w09_behaviour_score": WINDOW_SQL + _select(["behaviour_score"]),
    "w10_behaviour_vector": WINDOW_SQL + """
SELECT flow_id, CAST(7 AS INT) AS width, round(CAST(CAST(CAST(short AS DOUBLE)/n AS FLOAT) AS DOUBLE), 2) AS v1, CAST(ports AS DOUBLE) AS v2,
  CAST(n AS DOUBLE) AS v4, round(CAST(CAST(CAST(large AS DOUBLE)/n AS FLOAT) AS DOUBLE), 2) AS v5 FROM scored""",
    "w11_threat_density": FLOWS_SQL + """
SELECT step, round(coalesce(avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 0e0), 8) AS density_before,
  round(avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS density_after FROM flows""",
    "w11_gapped_density": FLOWS_SQL + """
SELECT step, round(coalesce(avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 0e0), 8) AS density_before,
  round(avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 8) AS density_after FROM flows WHERE k % 10 > 0""",
    "w12_cumulative_reward": _COUNTS_SQL + "SELECT step, round(cumulative_reward, 2) AS cumulative_reward FROM series",
    "w13_running_metrics": _COUNTS_SQL + _W13,
    "w14_dense_step": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS step FROM orders",
    "w14_dense_step_by_time": FLOWS_SQL + "SELECT flow_id, row_number() OVER (ORDER BY ts) AS step FROM flows",
    "w15_load_phase": FLOWS_SQL + """
SELECT flow_id, concat('part-0', CAST(chunk AS VARCHAR(5))) AS file,
  CASE chunk WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.7e0 ELSE 0.9e0 END AS analyst_load FROM flows""",
    "w15_load_phase_by_chunk": FLOWS_SQL + """,
c AS (SELECT * REPLACE (CASE WHEN k % 7 > 0 THEN chunk END AS chunk) FROM flows),
r AS (SELECT *, dense_rank() OVER (ORDER BY chunk NULLS LAST) AS place FROM c)
SELECT flow_id, phase, chunk, CASE place WHEN 1 THEN 0.1e0 WHEN 2 THEN 0.3e0 WHEN 3 THEN 0.5e0 WHEN 4 THEN 0.7e0 ELSE 0.9e0 END AS analyst_load FROM r""",
    "w16_learning_phase": _COUNTS_SQL + _W13 + " WHERE step <= 50000",
    "w17_progress_snapshots": _COUNTS_SQL + """
SELECT step, round(cumulative_reward, 0) AS cumulative_reward, CAST(round_even(precision, 4) AS DOUBLE) AS precision,
  CAST(round_even(recall, 4) AS DOUBLE) AS recall, CAST(round_even(f1, 4) AS DOUBLE) AS f1 FROM series WHERE step % 1000 = 0""",
    "w18_exploration": FLOWS_SQL + """
SELECT flow_id, round(CASE WHEN v = 0 THEN 1e0 ELSE greatest(0.01e0, 1 / (1 + 0.001e0 * v)) END, 6) AS epsilon FROM (
  SELECT flow_id, (row_number() OVER (PARTITION BY src_ip ORDER BY step) - 1) * 100 AS v FROM flows)""",
}
