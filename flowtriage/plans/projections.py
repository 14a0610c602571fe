"""Label, port, score and feed projections; predicates; lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import flow, triage
from flowtriage.operators import lookup, metrics, models, sampling
from flowtriage.operators.behaviour import with_source_rank
from flowtriage.plans.tables import (
    ACTION_SQL, DECISIONS_SQL, FLOWS_SQL, LEVEL_SQL, PORT_CLASS_SQL, Y_SQL,
    confusion_sql, decisions, flows, split_columns, table,
)

# Stand-in attributes the flow table lacks; one text for both engines.
SRC_PORT_SQL = "CASE k % 11 WHEN 0 THEN '22' WHEN 1 THEN '8443' WHEN 2 THEN 'x' WHEN 3 THEN NULL ELSE '50000' END"
FILE_SQL = (
    "CASE chunk WHEN 0 THEN 'dos_hulk.csv' WHEN 1 THEN 'DDoS1-Tuesday-20-02-2018_TrafficForML_CICFlowMeter.parquet' "
    "WHEN 2 THEN 'monday_benign.csv' WHEN 3 THEN 'web_xss.csv' WHEN 4 THEN 'portscan.csv' ELSE "
    "concat('part', CAST(chunk AS VARCHAR(5)), '.parquet') END"
)


def _case_map(entries: dict, subject: str, default: str) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in entries.items()) + f" ELSE {default} END"


FAMILY_SQL = _case_map(S.LABEL_FAMILIES, "lower(trim(label))", "trim(label)")


def p10_binary_label(spark, folder):
    return flows(spark, folder).select("flow_id", flow.binary_label(F.col("label")).alias("y"))


def p11_label_family(spark, folder):
    return flows(spark, folder).select("flow_id", flow.family(F.col("label")).alias("family"))


def p15_port_class(spark, folder):
    return flows(spark, folder).select("flow_id", flow.port_class(F.col("dst_port")).alias("port_class"))


def p16_service_port_mask(spark, folder):
    df = flows(spark, folder).withColumn("src_port", F.expr(SRC_PORT_SQL))
    ports = [F.col("dst_port"), F.col("src_port")]
    return df.select(
        "flow_id",
        flow.on_service_port(S.AUTH_PORTS, *ports).alias("auth"),
        flow.on_service_port(S.WEB_PORTS, *ports).alias("web"),
    )


def p17_attack_type_filter(spark, folder):
    df = flows(spark, folder).withColumn("label", flow.family(F.col("label")))
    return df.agg(*[F.count_if(flow.matches_attack_type(F.col("label"), t)).alias(t) for t in S.ATTACK_KEYWORDS])


def p18_preferred_source(spark, folder):
    df = flows(spark, folder).select(
        "flow_id", F.expr(FILE_SQL).alias("source_file"), flow.family(F.col("label")).alias("family")
    )
    return sampling.preferred_source_filter(df, "family", "source_file")


def p19_threat_level(spark, folder):
    return flows(spark, folder).select("flow_id", triage.threat_level(F.col("threat_score")).alias("level"))


def p20_traffic_feed(spark, folder):
    df = decisions(spark, folder)
    named = F.try_element_at(flow.literal_map(S.PORT_ENDPOINTS), F.col("dst_port"))
    start = F.lit(S.FEED_BASE_TIME).cast("timestamp_ntz")
    shown = F.timestamp_add("SECOND", F.col("step").cast("int"), start)
    return df.select(
        "step",
        F.date_format(shown, "HH:mm:ss").alias("time"),
        F.when(F.col("dst_port").isin(*S.FEED_POST_PORTS), "POST").otherwise("CONNECT").alias("method"),
        F.coalesce(named, F.concat(F.lit("/port_"), F.col("dst_port").cast("string"))).alias("endpoint"),
        triage.feed_tag(F.col("y"), F.col("action")).alias("tag"),
    )


def p22_detection_threshold(spark, folder):
    return flows(spark, folder).select(
        "flow_id", (F.col("threat_score") > triage.detection_threshold(F.col("dst_port"))).alias("detected")
    )


def p23_threshold_triage(spark, folder):
    return decisions(spark, folder).select("flow_id", "action", triage.action_name(F.col("action")).alias("action_name"))


_SOC_SQL = """event_id, CAST(k % 5 AS INT) AS severity_num,
  CASE event_type WHEN 'error' THEN 'service_install' WHEN 'signup' THEN 'autorun_entry' ELSE 'net_connection' END AS kind,
  CAST(k % 2 AS INT) AS is_internal_src, CASE k % 7 WHEN 0 THEN 'CN' ELSE 'US' END AS country,
  CASE k % 3 WHEN 0 THEN 'powershell.exe' ELSE 'sshd' END AS process"""


def p24_suspicion_score(spark, folder):
    events = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    soc = events.selectExpr(*split_columns(_SOC_SQL))
    score = flow.suspicion_score(*[F.col(c) for c in ("severity_num", "kind", "is_internal_src", "country", "process")])
    return soc.select("event_id", F.round(score, 4).alias("suspicion"))


_SRC_SQL = "CASE WHEN k % 4 = 0 THEN NULL ELSE src_ip END"


def p25_source_key(spark, folder):
    df = flows(spark, folder)
    return df.select("flow_id", flow.source_key(F.expr(_SRC_SQL), F.col("dst_port")).alias("src_key"))


def p26_specialist_subset(spark, folder):
    df = flows(spark, folder).withColumn("part", F.col("chunk") * 100 + F.col("k") % 50)
    return sampling.specialist_subset(df, "dst_port", S.WEB_PORTS, "part").select("flow_id", "part")


def p27_metric_bands(spark, folder):
    df = decisions(spark, folder)
    counts = metrics.confusion(df, F.col("y"), F.col("action") >= 1, by=["phase"])
    rates = triage.running_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select(
        "phase", *[triage.quality_band(rates[name], *band).alias(name) for name, band in triage.BANDS.items()]
    )


def j01_dimension_lookup(spark, folder):
    customers = table(spark, folder, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    nations = table(spark, folder, "nation").filter(F.col("n_regionkey") != 3)
    named = lookup.lookup_with_default(customers, nations, ["n_nationkey"], "n_name", F.lit("elsewhere"))
    return named.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def j03_membership(spark, folder):
    customers = table(spark, folder, "customer").withColumn("n_nationkey", F.col("c_nationkey"))
    allowed = table(spark, folder, "nation").filter(F.col("n_regionkey") == 1)
    return lookup.members(customers, allowed, ["n_nationkey"]).select("c_custkey", "c_nationkey")


def m08_mask_algebra(spark, folder):
    df = flows(spark, folder).withColumn("src_port", F.expr(SRC_PORT_SQL))
    ports = [F.col("dst_port"), F.col("src_port")]
    auth, web = flow.on_service_port(S.AUTH_PORTS, *ports), flow.on_service_port(S.WEB_PORTS, *ports)
    return df.select("flow_id", (web & ~auth).alias("web_only"), (web | auth).alias("specialist"), (web & auth).alias("both"))


def l12_score_routing(spark, folder):
    df = flows(spark, folder).withColumns({"src_port": F.expr(SRC_PORT_SQL), "source_file": F.expr(FILE_SQL)})
    routed = df.withColumn(
        "route", models.route([F.col("dst_port"), F.col("src_port")], F.col("source_file"), F.col("flow_pkts_s"))
    )
    s = F.col("threat_score")
    scores = {"main": s, "auth": s * 0.5, "web": s * 0.25, "flood": F.sqrt(s)}
    return routed.select("flow_id", "route", F.round(models.routed_score(F.col("route"), scores), 8).alias("score"))


def b12_outcome_tag(spark, folder):
    df = decisions(spark, folder).withColumn("label", F.when(F.col("k") % 9 == 0, "Unknown").otherwise(F.col("label")))
    return df.select("flow_id", triage.outcome(flow.ground_truth(F.col("label")), F.col("action") >= 1).alias("outcome"))


def b13_result_row(spark, folder):
    df = decisions(spark, folder)
    fused = triage.fused_score(F.col("threat_score"), F.col("k") / 200)
    return df.select(
        F.col("step").alias("row"),
        F.trim("label").alias("label"),
        F.bround("threat_score", 4).alias("threat_score"),
        F.round(fused, 4).alias("fused_score"),
        triage.threat_level(fused).alias("threat_level"),
        triage.action_name(F.col("action")).alias("action"),
        triage.outcome(flow.ground_truth(F.col("label")), F.col("action") >= 1).alias("outcome"),
    )


def b01_state_buckets(spark, folder):
    df = decisions(spark, folder)
    state = triage.state_columns(F.col("threat_score"), F.col("analyst_load"), F.col("threat_score") * 1.1, F.col("dst_port"))
    return df.select("flow_id", *[e.alias(n) for n, e in state.items()])


def b06_reward(spark, folder):
    return decisions(spark, folder).select("flow_id", F.round("reward", 4).alias("reward"))


def b07_learning_rate(spark, folder):
    visited = with_source_rank(flows(spark, folder), "src_ip", "step")
    return visited.select("flow_id", F.round(triage.learning_rate(F.col("src_rank")), 6).alias("rate"))


def l13_score_fusion(spark, folder):
    return flows(spark, folder).select(
        "flow_id", F.round(triage.fused_score(F.col("threat_score"), F.col("flow_duration") / 500000), 8).alias("fused")
    )


QUERIES = {f.__name__: f for f in (
    p10_binary_label, p11_label_family, p15_port_class, p16_service_port_mask, p17_attack_type_filter,
    p18_preferred_source, p19_threat_level, p20_traffic_feed, p22_detection_threshold, p23_threshold_triage,
    p24_suspicion_score, p25_source_key, p26_specialist_subset, p27_metric_bands, j01_dimension_lookup,
    j03_membership, m08_mask_algebra, l12_score_routing, l13_score_fusion, b01_state_buckets, b06_reward,
    b07_learning_rate, b12_outcome_tag, b13_result_row,
)}

_AUTH = "(21,22,23,1433,3306,3389,5432,5900,6379,27017)"
_WEB = "(80,443,3000,5000,8000,8080,8443,8888)"
_MASKS = f"""SELECT *, (dst_port IN {_AUTH} OR coalesce(TRY_CAST(src_port AS DOUBLE) IN {_AUTH}, false)) AS auth,
  (dst_port IN {_WEB} OR coalesce(TRY_CAST(src_port AS DOUBLE) IN {_WEB}, false)) AS web
  FROM (SELECT *, {SRC_PORT_SQL} AS src_port, {FILE_SQL} AS source_file FROM flows)"""
_TRUTH = "(CASE WHEN lower(trim(label)) = 'unknown' THEN NULL WHEN lower(trim(label)) = 'benign' THEN 0 ELSE 1 END)"
_OUTCOME = (
    "(CASE WHEN truth IS NULL THEN '?' WHEN truth = 1 AND action >= 1 THEN 'TP' WHEN action >= 1 THEN 'FP' "
    "WHEN truth = 1 THEN 'FN' ELSE 'TN' END)"
)
_KEYWORD_SQL = ", ".join(
    "count(*) FILTER (WHERE lower(trim(fam)) <> 'benign'"
    + ("" if not words else " AND (" + " OR ".join(f"contains(lower(trim(fam)), {w!r})" for w in words) + ")")
    + f') AS "{name}"'
    for name, words in S.ATTACK_KEYWORDS.items()
)


def _band(name: str) -> str:
    good, fair, lower = triage.BANDS[name]
    sign = "<=" if lower else ">="
    return f"CASE WHEN {name} {sign} {good}e0 THEN 'green' WHEN {name} {sign} {fair}e0 THEN 'yellow' ELSE 'red' END AS {name}"


ORACLES = {
    "p10_binary_label": FLOWS_SQL + f"SELECT flow_id, {Y_SQL} AS y FROM flows",
    "p11_label_family": FLOWS_SQL + f"SELECT flow_id, {FAMILY_SQL} AS family FROM flows",
    "p15_port_class": FLOWS_SQL + f"SELECT flow_id, {PORT_CLASS_SQL} AS port_class FROM flows",
    "p16_service_port_mask": FLOWS_SQL + f"SELECT flow_id, auth, web FROM ({_MASKS})",
    "p17_attack_type_filter": FLOWS_SQL + f"SELECT {_KEYWORD_SQL} FROM (SELECT {FAMILY_SQL} AS fam FROM flows)",
    "p18_preferred_source": FLOWS_SQL + f"""
, f AS (SELECT flow_id, {FILE_SQL} AS source_file, {FAMILY_SQL} AS family FROM flows),
p AS (SELECT *, {_case_map(S.PREFERRED_SOURCES, 'lower(trim(family))', 'NULL')} AS pref FROM f)
SELECT flow_id, source_file, family FROM p
WHERE pref IS NULL OR pref NOT IN (SELECT lower(source_file) FROM f) OR lower(source_file) = pref""",
    "p19_threat_level": FLOWS_SQL + f"SELECT flow_id, {LEVEL_SQL} AS level FROM flows",
    "p20_traffic_feed": DECISIONS_SQL + """
SELECT step, strftime(TIMESTAMP '2026-03-22 12:00:00' + to_seconds(step), '%H:%M:%S') AS time,
  CASE WHEN dst_port IN (80,443,8080) THEN 'POST' ELSE 'CONNECT' END AS method,
  CASE dst_port WHEN 80 THEN '/http/traffic' WHEN 443 THEN '/https/secure' WHEN 22 THEN '/ssh/auth'
    WHEN 21 THEN '/ftp/transfer' WHEN 53 THEN '/dns/query' WHEN 3389 THEN '/rdp/remote' WHEN 445 THEN '/smb/share'
    WHEN 8080 THEN '/proxy/alt' ELSE concat('/port_', dst_port) END AS endpoint,
  CASE WHEN action = 2 THEN 'BLOCKED - IP ON BLOCK LIST' WHEN y = 1 AND action = 0 THEN 'FAIL'
    WHEN action = 1 THEN 'DENIED - RESTRICTED ENDPOINT' ELSE 'ALLOWED' END AS tag
FROM decisions""",
    "p22_detection_threshold": FLOWS_SQL + f"SELECT flow_id, threat_score > (CASE WHEN dst_port IN {_WEB} THEN 0.35e0 ELSE 0.5e0 END) AS detected FROM flows",
    "p23_threshold_triage": DECISIONS_SQL + f"SELECT flow_id, action, {ACTION_SQL} AS action_name FROM decisions",
    "p24_suspicion_score": f"""
WITH events_with_k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
soc AS (SELECT {_SOC_SQL} FROM events_with_k)
SELECT event_id, round(least(0.95e0, 0.04e0 + CASE WHEN severity_num >= 3 THEN 0.15e0 ELSE 0e0 END
  + CASE WHEN severity_num = 4 THEN 0.10e0 ELSE 0e0 END
  + CASE WHEN kind IN ('autorun_entry','service_install','scheduled_task_created') THEN 0.35e0 ELSE 0e0 END
  + CASE WHEN is_internal_src = 0 THEN 0.05e0 ELSE 0e0 END + CASE WHEN country = 'CN' THEN 0.10e0 ELSE 0e0 END
  + CASE WHEN process = 'powershell.exe' THEN 0.12e0 ELSE 0e0 END), 4) AS suspicion FROM soc""",
    "p25_source_key": FLOWS_SQL + f"SELECT flow_id, coalesce({_SRC_SQL}, concat('row_', dst_port)) AS src_key FROM flows",
    "p26_specialist_subset": FLOWS_SQL + f"""
SELECT flow_id, part FROM (SELECT *, count(*) OVER (PARTITION BY part) AS c FROM (
  SELECT flow_id, CAST(chunk * 100 + k % 50 AS INT) AS part FROM flows WHERE dst_port IN {_WEB})) WHERE c >= 20""",
    "p27_metric_bands": DECISIONS_SQL + f"""
SELECT phase, {', '.join(_band(n) for n in triage.BANDS)} FROM (
  SELECT *, 2*precision*recall/greatest(precision+recall, 1e-9) AS f1 FROM (
    SELECT phase, CAST(tp AS DOUBLE)/greatest(tp+fp,1) AS precision, CAST(tp AS DOUBLE)/greatest(tp+fn,1) AS recall,
      CAST(fp AS DOUBLE)/greatest(fp+tn,1) AS fpr
    FROM (SELECT phase, {confusion_sql('action >= 1')} FROM decisions GROUP BY phase)))""",
    "j01_dimension_lookup": """
SELECT coalesce(n_name, 'elsewhere') AS n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance
FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON c_nationkey = n_nationkey GROUP BY 1""",
    "j03_membership": "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "m08_mask_algebra": FLOWS_SQL + f"SELECT flow_id, web AND NOT auth AS web_only, web OR auth AS specialist, web AND auth AS both FROM ({_MASKS})",
    "l12_score_routing": FLOWS_SQL + f"""
SELECT flow_id, route, round(CASE route WHEN 'auth' THEN threat_score*0.5e0 WHEN 'web' THEN threat_score*0.25e0
  WHEN 'flood' THEN sqrt(threat_score) ELSE threat_score END, 8) AS score FROM (
  SELECT *, CASE WHEN auth THEN 'auth' WHEN web THEN 'web'
    WHEN lower(source_file) IN ({', '.join(repr(f) for f in S.FLOOD_STREAM_FILES)}) AND flow_pkts_s > 50e0 THEN 'flood'
    ELSE 'main' END AS route FROM ({_MASKS}))""",
    "l13_score_fusion": FLOWS_SQL + "SELECT flow_id, round(greatest(threat_score, flow_duration / 500000e0), 8) AS fused FROM flows",
    "b01_state_buckets": DECISIONS_SQL + f"""
SELECT flow_id, CAST(floor(least(19e0, threat_score*20)) AS INT) AS tb, CAST(floor(least(19e0, analyst_load*20)) AS INT) AS lb,
  CAST(floor(least(4e0, threat_score*1.1e0*5)) AS INT) AS db, {PORT_CLASS_SQL} AS pb FROM decisions""",
    "b06_reward": DECISIONS_SQL + "SELECT flow_id, round(reward, 4) AS reward FROM decisions",
    "b07_learning_rate": FLOWS_SQL + "SELECT flow_id, round(0.15e0 / (1 + 0.001e0 * row_number() OVER (PARTITION BY src_ip ORDER BY step)), 6) AS rate FROM flows",
    "b12_outcome_tag": DECISIONS_SQL + f"""
SELECT flow_id, {_OUTCOME} AS outcome FROM (SELECT *, {_TRUTH} AS truth FROM (
  SELECT * REPLACE (CASE WHEN k % 9 = 0 THEN 'Unknown' ELSE label END AS label) FROM decisions))""",
    "b13_result_row": DECISIONS_SQL + f"""
SELECT step AS row, trim(label) AS label, threat_score, round(fused, 4) AS fused_score,
  CASE WHEN fused > 0.7e0 THEN 'HIGH' WHEN fused > 0.3e0 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
  {ACTION_SQL} AS action, {_OUTCOME} AS outcome
FROM (SELECT *, greatest(threat_score, k / 200e0) AS fused, {_TRUTH} AS truth FROM decisions)""",
}
