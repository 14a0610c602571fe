"""Samples, splits, top-k and quota queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage.functions import flow
from flowtriage.operators import sampling
from flowtriage.plans.projections import FAMILY_SQL
from flowtriage.plans.tables import DECISIONS_SQL, FLOWS_SQL, Y_SQL, decisions, flows, table
from flowtriage.sources.workspace import durable


def t01_file_split(spark, folder):
    docs = table(spark, folder, "documents")
    return sampling.with_split(docs.select("doc_id", "source"), "source")


def t02_top_labels(spark, folder):
    return sampling.top_labels(table(spark, folder, "orders"), F.col("o_orderpriority"), limit=4)


def t04_result_page(spark, folder):
    rows = decisions(spark, folder).select("step", "threat_score", "action")
    return sampling.result_page(rows, "step")


def t05_representative_log(spark, folder):
    # The log is read four times, so it is stored first, as a decision log would be.
    log = durable(decisions(spark, folder).select("step", "threat_score", "action", F.col("y").alias("true_label")))
    return sampling.representative_log(log)


def t06_sorted_distribution(spark, folder):
    df = flows(spark, folder)
    return df.groupBy(flow.family(F.col("label")).alias("family")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family")


def m01_calibration_sample(spark, folder):
    return sampling.calibration_sample(flows(spark, folder), "chunk", "flow_id").select("chunk", "flow_id")


def _with_y(spark, folder):
    return flows(spark, folder).withColumn("y", flow.binary_label(F.col("label")))


def m02_class_seeds(spark, folder):
    seeds = sampling.newest_class_seeds(_with_y(spark, folder), "chunk", "y", "flow_id", rows=200)
    return seeds.select("chunk", "y", "flow_id")


# Every row in a chunk; chunks with one class only: 0 and 1 benign (they wait), 4 attacks, 6 benign.
_ONE_CLASS = "CASE WHEN y = 1 AND chunk IN (0, 1, 6) THEN chunk + 2 WHEN y = 0 AND chunk = 4 THEN 5 ELSE chunk END"


def m03_single_class_augmentation(spark, folder):
    df = _with_y(spark, folder).withColumn("chunk", F.expr(_ONE_CLASS))
    return sampling.augment_single_class(df, "chunk", "y", "flow_id", rows=200).select("batch", "chunk", "y", "flow_id", "is_seed")


def m04_ratio_sample(spark, folder):
    df = flows(spark, folder)
    picked = sampling.ratio_sample(df, flow.binary_label(F.col("label")), "flow_id", 500, 0.4)
    return picked.select("flow_id", "label", "order_key")


def m05_round_robin(spark, folder):
    # Families of attacks, one of them hard to detect, split further by port.
    df = flows(spark, folder).withColumn("family", flow.family(F.col("label"))).filter(flow.binary_label(F.col("label")) == 1)
    return sampling.round_robin(df, "family", "flow_id", 60).select("position", "family", "flow_id")


def m06_holdout_split(spark, folder):
    return sampling.holdout_split(flows(spark, folder), "flow_id").select("flow_id", "is_eval")


def m07_union_all(spark, folder):
    df = flows(spark, folder).select("flow_id", "label")
    benign = flow.binary_label(F.col("label")) == 0
    sample = sampling.calibration_sample(flows(spark, folder), "chunk", "flow_id").select("flow_id", "label")
    return df.filter(benign).unionByName(df.filter(~benign)).unionByName(sample)


QUERIES = {f.__name__: f for f in (
    t01_file_split, t02_top_labels, t04_result_page, t05_representative_log, t06_sorted_distribution,
    m01_calibration_sample, m02_class_seeds, m03_single_class_augmentation, m04_ratio_sample, m05_round_robin,
    m06_holdout_split, m07_union_all,
)}

_HASH = "md5(concat(CAST(flow_id AS VARCHAR), ':42'))"
_CAL = f"""cal AS (SELECT chunk, flow_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY {_HASH}) AS rn, count(*) OVER (PARTITION BY chunk) AS c FROM flows)
  WHERE rn <= least(c // 20, 10000))"""
_YED = f"yed AS (SELECT *, {Y_SQL} AS y FROM flows)"

ORACLES = {
    "t01_file_split": """
SELECT doc_id, source, rk <= greatest(1, CAST(floor(n * 0.8e0) AS INT)) AS is_train FROM documents JOIN (
  SELECT source, dense_rank() OVER (ORDER BY source) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) USING (source)""",
    "t02_top_labels": """
SELECT * FROM (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, label LIMIT 4) WHERE n >= 5""",
    "t04_result_page": DECISIONS_SQL + """
SELECT step, threat_score, action, (SELECT count(*) FROM decisions) AS total_rows, (SELECT count(*) FROM decisions) > 500 AS rows_truncated
FROM decisions ORDER BY step LIMIT 500""",
    "t05_representative_log": DECISIONS_SQL + """
, s AS (SELECT *, CASE WHEN y = 1 THEN 'threat' WHEN action = 2 THEN 'escalated' WHEN action = 1 THEN 'monitored' ELSE 'dismissed' END AS stratum,
  CASE WHEN y = 1 THEN '42' WHEN action = 2 THEN '43' ELSE '44' END AS seed FROM decisions),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat(CAST(step AS VARCHAR), ':', seed))) AS rn,
  row_number() OVER (PARTITION BY stratum ORDER BY step) - 1 AS pos, count(*) OVER (PARTITION BY stratum) AS pool FROM s),
picked AS (SELECT * FROM r WHERE (stratum = 'threat' AND rn <= 50) OR (stratum = 'escalated' AND rn <= 10) OR (stratum = 'monitored' AND rn <= 15)),
room AS (SELECT 100 - count(*) AS room FROM picked)
SELECT step, threat_score, action, y AS true_label FROM picked
UNION ALL SELECT step, threat_score, action, y FROM r, room
WHERE stratum = 'dismissed' AND pos % greatest(1, pool // room) = 0 AND pos // greatest(1, pool // room) < room""",
    "t06_sorted_distribution": FLOWS_SQL + f"SELECT {FAMILY_SQL} AS family, count(*) AS n FROM flows GROUP BY 1 ORDER BY n DESC, family",
    "m01_calibration_sample": FLOWS_SQL + f", {_CAL} SELECT chunk, flow_id FROM cal",
    "m02_class_seeds": FLOWS_SQL + f""", {_YED}
SELECT chunk, y, flow_id FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}) AS rn FROM (
  SELECT *, max(chunk) OVER (PARTITION BY y) AS newest FROM yed) WHERE chunk = newest) WHERE rn <= 200""",
    "m03_single_class_augmentation": FLOWS_SQL + f""", {_YED},
kept AS (SELECT * REPLACE (CAST({_ONE_CLASS} AS INT) AS chunk) FROM yed),
seeds AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk, y ORDER BY {_HASH}) AS rn FROM kept) WHERE rn <= 200)
SELECT greatest(chunk, 2) AS batch, chunk, y, flow_id, false AS is_seed FROM kept
UNION ALL SELECT 4, chunk, y, flow_id, true FROM seeds WHERE chunk = 3 AND y = 0
UNION ALL SELECT 6, chunk, y, flow_id, true FROM seeds WHERE chunk = 5 AND y = 1""",
    "m04_ratio_sample": FLOWS_SQL + f""", {_YED}
SELECT flow_id, label, {_HASH} AS order_key FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH}) AS rn FROM yed)
WHERE rn <= CASE WHEN y = 1 THEN 200 ELSE 300 END""",
    "m05_round_robin": FLOWS_SQL + f""", {_YED},
n AS (SELECT *, {FAMILY_SQL} AS family, {_HASH} AS h FROM yed WHERE y = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY h) AS rn FROM n),
t AS (SELECT *, rn - CASE WHEN family = (SELECT family FROM r WHERE rn = 1 AND family IN ('PortScan', 'SQL Injection') ORDER BY h LIMIT 1) THEN 1 ELSE 0 END AS turn FROM r)
SELECT row_number() OVER (ORDER BY turn, family) AS position, family, flow_id FROM t ORDER BY turn, family LIMIT 60""",
    "m06_holdout_split": FLOWS_SQL + f"""
SELECT flow_id, row_number() OVER (ORDER BY {_HASH}) <= greatest(1, CAST(floor(count(*) OVER () * 0.1e0) AS BIGINT)) AS is_eval FROM flows""",
    "m07_union_all": FLOWS_SQL + f", {_CAL} SELECT flow_id, label FROM flows UNION ALL SELECT flow_id, label FROM cal",
}
