"""The whole way of an uploaded table: read, score with a stored model, decide, report."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.operators import policy, scoring
from flowtriage.plans.policy import _COLD
from flowtriage.plans.projections import FAMILY_SQL
from flowtriage.plans.scans import SNAKE_HEADERS, in_dialect
from flowtriage.plans.streams import flow_stream
from flowtriage.plans.tables import FLOWS_SQL, LEVEL_SQL, Y_SQL, confusion_sql, rates_sql
from flowtriage.plans.windows import BLOCK, _CAPPED, _SCORED, _stats
from flowtriage.sources import readers, sinks
from flowtriage.sources.workspace import durable, new_folder
from flowtriage.streaming import jobs

# A stored detector whose score SQL can repeat: the share of 99 further packets.
_RULE = """SELECT *, CAST(1 - p AS DOUBLE) AS _p0, CAST(p AS DOUBLE) AS _p1 FROM
  (SELECT *, least(1e0, (`Tot Fwd Pkts` - 1) / 99e0 * {share}) AS p FROM __THIS__)"""


_FILE = f"CASE WHEN k % 3 = 0 THEN '{S.FLOOD_STREAM_FILES[0]}' ELSE 'other.csv' END"


def _stored_detector(spark, share: float) -> PipelineModel:
    stages = [
        SQLTransformer(statement=_RULE.format(share=share)),
        VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability"),
        SQLTransformer(statement="SELECT *, CAST(_p1 > 0.5 AS DOUBLE) AS prediction FROM __THIS__"),
    ]
    path = new_folder(spark, "detector")
    sinks.save_model(Pipeline(stages=stages).fit(spark.range(1)), path)
    return PipelineModel.load(path)


def _scored(spark, folder):
    """An upload without sources, scored by a main and a web detector under an empty policy."""
    target = new_folder(spark, "upload")
    snake = in_dialect(spark, folder, {**SNAKE_HEADERS, "src_port": "flow_id"}).drop("flow_id")
    snake.coalesce(1).write.csv(target, header=True)  # an upload is one file
    (path,) = readers.list_files(spark, target)
    flows = readers.read_upload(spark, path).withColumn("step", F.col("src_port").cast("long") + 1)
    detectors = {"main": _stored_detector(spark, 1.0), "web": _stored_detector(spark, 0.5)}
    # The report and the score table read no feature once the flows are scored.
    return scoring.score_table(flows, detectors, {}, policy.empty_policy(spark), F.lit(0.5), block_rows=BLOCK, keep=())


def x01_score_table(spark, folder):
    return _scored(spark, folder).select(
        "step", "route", F.round("threat_score", 3).alias("threat_score"), F.round("fused_score", 3).alias("fused_score"),
        "action", "level", "detected",
    )


def x02_score_report(spark, folder):
    # Scored once; the report reads the stored scores, as a user would keep them.
    return scoring.score_report(durable(_scored(spark, folder), "scores"))


def r10_stream_with_models(spark, folder):
    """Raw flows of two capture files on a stream, scored by main, web and flood detectors."""
    base = flow_stream(spark, folder).withColumn("file", F.expr(_FILE))
    names = {**SNAKE_HEADERS, "src_port": "flow_id", "flow_id": "flow_id", "file": "file", "label": "label"}
    raw = base.select(*[F.col(c).alias(h) for h, c in names.items()])
    detectors = {n: _stored_detector(spark, share) for n, share in (("main", 1.0), ("web", 0.5), ("flood", 0.8))}
    acted = jobs.triage_raw(raw, detectors, {}, "file", keep={"flow_id": "flow_id"})
    done = jobs.run_to_table(acted.select("flow_id", "route", "threat_score", "action", "level", "outcome"))
    return done.withColumn("threat_score", F.round("threat_score", 6))


QUERIES = {f.__name__: f for f in (x01_score_table, x02_score_report, r10_stream_with_models)}

_WEB, _AUTH = "(80,443,3000,5000,8000,8080,8443,8888)", "(21,22,23,1433,3306,3389,5432,5900,6379,27017)"
_ON = "(dst_port IN {0} OR flow_id IN {0})"
_SCORED_SQL = FLOWS_SQL + f""",
keyed AS (SELECT * REPLACE ('row_' || CAST(dst_port AS VARCHAR(9)) AS src_ip), CASE WHEN {_ON.format(_AUTH)} THEN 'auth'
  WHEN {_ON.format(_WEB)} THEN 'web' ELSE 'main' END AS route FROM flows),
rated AS (SELECT * REPLACE (k / 99e0 * (CASE WHEN route = 'web' THEN 0.5e0 ELSE 1e0 END) AS threat_score) FROM keyed),
suffix AS (SELECT * REPLACE (ts AS first) FROM (SELECT *, {_stats(_CAPPED.format(rows=199).replace("ORDER BY ts", "ORDER BY step"))} FROM rated)),
{_SCORED},
fused AS (SELECT *, greatest(threat_score, score) AS fused_score FROM scored),
done AS (SELECT *, {_COLD.replace("threat_score", "fused_score")} AS action, {LEVEL_SQL.replace("threat_score", "fused_score")} AS level,
  fused_score > (CASE WHEN dst_port IN {_WEB} THEN 0.35e0 ELSE 0.5e0 END) AS detected, {Y_SQL} AS y, {FAMILY_SQL} AS family FROM fused)
"""

_STREAM_SQL = FLOWS_SQL + f""",
routed AS (SELECT *, CASE WHEN {_ON.format(_AUTH)} THEN 'auth' WHEN {_ON.format(_WEB)} THEN 'web'
  WHEN lower({_FILE}) <> 'other.csv' AND flow_pkts_s > 50 THEN 'flood' ELSE 'main' END AS route FROM flows),
rated AS (SELECT * REPLACE (k / 99e0 * (CASE route WHEN 'web' THEN 0.5e0 WHEN 'flood' THEN 0.8e0 ELSE 1e0 END) AS threat_score), {Y_SQL} AS y FROM routed),
acted AS (SELECT *, CASE WHEN threat_score >= 0.75e0 THEN 2
  WHEN threat_score >= (CASE WHEN route <> 'main' THEN 0.30e0 ELSE 0.35e0 END) THEN 1 ELSE 0 END AS action FROM rated)
"""

ORACLES = {
    "r10_stream_with_models": _STREAM_SQL + f"""
SELECT flow_id, route, round(threat_score, 6) AS threat_score, action, {LEVEL_SQL} AS level, CASE WHEN y = 1 AND action >= 1 THEN 'TP' WHEN action >= 1 THEN 'FP'
  WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome FROM acted""",
    "x01_score_table": _SCORED_SQL + """
SELECT step, route, round(threat_score, 3) AS threat_score, round(fused_score, 3) AS fused_score, action, level, detected FROM done""",
    "x02_score_report": _SCORED_SQL + "," + rates_sql(
        "SELECT trim(family) AS label, count(*) AS n, CAST(round_even(avg(round_even(threat_score, 4)), 4) AS DOUBLE) AS avg_score, "
        f"{confusion_sql('detected')} FROM done GROUP BY 1"
    ),
}
