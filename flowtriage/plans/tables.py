"""Input tables of the registered queries, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.functions import flow, triage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


# The event table seen as network flows; the text runs in both engines, except
# that the port is an array lookup in Spark so that k is evaluated once.
_PORT_SQL = """CASE k % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 22
             WHEN 4 THEN 3389 WHEN 5 THEN 21 WHEN 6 THEN 53 ELSE 445 END"""
_PORT_SPARK = "array(80, 443, 8080, 22, 3389, 21, 53, 445)[k % 8]"
_FLOW_COLUMNS = """
  event_id AS flow_id, event_id + 1 AS step, ts,
  CAST(user_id AS VARCHAR(20)) AS src_ip,
  {port} AS dst_port,
  value * 1000 AS flow_duration, k + 1 AS tot_fwd_pkts,
  value * 100 AS totlen_fwd_pkts, value * 100 / (k + 1) AS pkt_size_avg,
  coalesce((k + 1) * 1e6 / nullif(value * 1000, 0), 0e0) AS flow_pkts_s,
  CASE event_type WHEN 'error' THEN 'DoS_Hulk' WHEN 'signup' THEN ' Port_Scan '
       WHEN 'purchase' THEN 'Benign' WHEN 'view' THEN 'BENIGN ' ELSE 'benign' END AS label,
  round(k / 99e0, 4) AS threat_score,
  CAST(floor((day(ts) - 1) / 6e0) AS INT) AS phase,
  CAST(floor((day(ts) - 1) / 3e0) AS INT) AS chunk,
  k
"""


def split_columns(text: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for char in text:
        depth += (char in "([") - (char in ")]")
        if char == "," and depth == 0:
            parts.append(current.strip())
            current = ""
        else:
            current += char
    return [*parts, current.strip()]


def events_as_flows(events: DataFrame) -> DataFrame:
    keyed = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return keyed.selectExpr(*split_columns(_FLOW_COLUMNS.format(port=_PORT_SPARK)))


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_flows(table(spark, folder, "events"))


FLOWS_SQL = f"""
WITH events_with_k AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
flows AS (SELECT {_FLOW_COLUMNS.format(port=_PORT_SQL)} FROM events_with_k)
"""


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return with_decisions(flows(spark, folder))


def with_decisions(base: DataFrame) -> DataFrame:
    """Flows with truth, load, a threshold action and its reward."""
    score, port = F.col("threat_score"), F.col("dst_port")
    return (
        base.withColumns(
            {
                "y": flow.binary_label(F.col("label")),
                "analyst_load": flow.phase_load(F.col("phase")),
                "action": triage.threshold_action(score, flow.port_class(port) < 2),
            }
        )
        .withColumn("reward", triage.reward(F.col("y"), F.col("action"), F.col("analyst_load"), score))
    )


LOAD_SQL = "(CASE phase WHEN 0 THEN 0.1e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.5e0 WHEN 3 THEN 0.7e0 ELSE 0.9e0 END)"
Y_SQL = "(CASE WHEN lower(trim(label)) = 'benign' THEN 0 ELSE 1 END)"
PORT_CLASS_SQL = (
    "(CASE WHEN dst_port IN (80,443,3000,5000,8000,8080,8443,8888) THEN 0 "
    "WHEN dst_port IN (21,22,23,1433,3306,3389,5432,5900,6379,27017) THEN 1 ELSE 2 END)"
)


def reward_sql(y: str, action: str, load: str, score: str) -> str:
    return (
        f"(CASE WHEN {y}=1 AND {action}=0 THEN -3000e0*(1+{score}) WHEN {y}=1 AND {action}=2 THEN 100e0*(1+{score}) "
        f"WHEN {y}=1 THEN 50e0*(1-{load}) WHEN {action}=0 THEN 15e0 WHEN {action}=2 THEN -120e0*(1+{load}) ELSE -75e0 END)"
    )


DECISIONS_SQL = FLOWS_SQL + f""",
acted AS (
  SELECT *, {Y_SQL} AS y, {LOAD_SQL} AS analyst_load,
    CASE WHEN threat_score >= 0.75e0 THEN 2
         WHEN threat_score >= (CASE WHEN {PORT_CLASS_SQL} < 2 THEN 0.30e0 ELSE 0.35e0 END) THEN 1
         ELSE 0 END AS action
  FROM flows),
decisions AS (SELECT *, {reward_sql('y', 'action', 'analyst_load', 'threat_score')} AS reward FROM acted)
"""

ACTION_SQL = "(CASE action WHEN 0 THEN 'Dismiss' WHEN 1 THEN 'Monitor' ELSE 'Escalate' END)"
LEVEL_SQL = "(CASE WHEN threat_score > 0.7e0 THEN 'HIGH' WHEN threat_score > 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END)"


def rates_sql(source: str) -> str:
    """Reported rates over a relation that has tp, fp, fn, tn."""
    return f"""
  SELECT *,
    round_even(2*precision*recall/greatest(precision+recall, 1e0), 4) AS f1_compat,
    round_even(2*precision*recall/greatest(precision+recall, 1e-9), 4) AS f1
  FROM (SELECT *,
      CAST(round_even(CAST(tp AS DOUBLE)/greatest(tp+fp, 1), 4) AS DOUBLE) AS precision,
      CAST(round_even(CAST(tp AS DOUBLE)/greatest(tp+fn, 1), 4) AS DOUBLE) AS recall,
      CAST(round_even(CAST(fp AS DOUBLE)/greatest(fp+tn, 1), 4) AS DOUBLE) AS fpr
    FROM ({source}))"""


CONFUSION_SQL = """
  count(*) FILTER (WHERE {y} = 1 AND {pos}) AS tp,
  count(*) FILTER (WHERE {y} = 0 AND {alarm}) AS fp,
  count(*) FILTER (WHERE {y} = 1 AND NOT ({pos})) AS fn,
  count(*) FILTER (WHERE {y} = 0 AND NOT ({alarm})) AS tn"""


def confusion_sql(pos: str, alarm: str | None = None, y: str = "y") -> str:
    return CONFUSION_SQL.format(y=y, pos=pos, alarm=alarm or pos)
