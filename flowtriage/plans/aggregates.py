"""Confusion, family, reward and distribution reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage.functions import flow, triage
from flowtriage.operators import behaviour, metrics, policy
from flowtriage.operators.ordered import threat_density
from flowtriage.plans.tables import (
    ACTION_SQL, DECISIONS_SQL, FLOWS_SQL, LEVEL_SQL, PORT_CLASS_SQL, Y_SQL,
    confusion_sql, decisions, flows, rates_sql, table,
)
from flowtriage.plans.projections import FAMILY_SQL
from flowtriage.sources.workspace import durable
from flowtriage.plans.windows import BLOCK, DAY_SECONDS, WINDOW_SQL

FLOW_FEATURES = ["flow_duration", "tot_fwd_pkts", "totlen_fwd_pkts", "pkt_size_avg", "flow_pkts_s"]
ITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

def rounded(df, columns, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def items(spark, folder):
    """Line items as a wide numeric table with a class and a chunk."""
    return table(spark, folder, "lineitem").withColumns(
        {
            "y": (F.col("l_returnflag") != "N").cast("int"),
            "predicted": (F.col("l_linestatus") == "F").cast("int"),
            "month": F.date_format("l_shipdate", "yyyy-MM"),
        }
    )


ITEMS_SQL = """
WITH items AS (SELECT *, CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END AS y,
  CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS predicted, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem)
"""


def labelled_documents(spark, folder):
    return table(spark, folder, "labels").select(
        F.col("toxic").alias("y"), (1 - F.col("quality")).alias("action"), "doc_id"
    )


def fused_family_report(spark, folder):
    """Behaviour windows, fusion with the detector score, per-family report."""
    scored = behaviour.behaviour_features(
        flows(spark, folder), window_seconds=DAY_SECONDS, block_rows=BLOCK, keep=["dst_port", "threat_score", "label"]
    )
    fused = triage.fused_score(F.col("threat_score"), F.col("behaviour_score"))
    detected = fused > triage.detection_threshold(F.col("dst_port"))
    return metrics.family_report(
        scored.withColumn("family", flow.family(F.col("label"))), F.col("family"), F.col("threat_score"),
        flow.binary_label(F.col("label")), detected,
    )


def a01_label_distribution(spark, folder):
    return metrics.label_counts(flows(spark, folder), F.col("label"))


def a02_class_distribution(spark, folder):
    df = flows(spark, folder)
    # Benign spellings are one family.
    family = F.when(flow.binary_label(F.col("label")) == 0, "Benign").otherwise(flow.family(F.col("label")))
    return rounded(metrics.class_distribution(df, family, flow.binary_label(F.col("label"))), ["share"], 6)


def a03_label_medians(spark, folder):
    medians = metrics.label_medians(flows(spark, folder), flow.family(F.col("label")), FLOW_FEATURES)
    return rounded(medians, ["median"])


def a04_class_statistics(spark, folder):
    stats = metrics.class_statistics(items(spark, folder), ITEM_FEATURES, F.col("y"))
    return rounded(stats, ["benign_mean", "benign_std", "attack_mean", "attack_std"], 1)


def a05_scaler_statistics(spark, folder):
    return rounded(metrics.scaler_statistics(items(spark, folder), ITEM_FEATURES), ["mean", "std"])


def a06_detector_confusion(spark, folder):
    df = flows(spark, folder).withColumn("label", F.when(F.col("k") % 9 == 0, "Unknown").otherwise(F.col("label")))
    detected = F.col("threat_score") > triage.detection_threshold(F.col("dst_port"))
    return metrics.confusion(df, flow.ground_truth(F.col("label")), detected)


def a07_agent_confusion_strict(spark, folder):
    return metrics.confusion(decisions(spark, folder), F.col("y"), F.col("action") >= 1)


def a08_agent_confusion_pipeline(spark, folder):
    return metrics.confusion(decisions(spark, folder), F.col("y"), F.col("action") >= 1, false_alarm=F.col("action") == 2)


def a09_quality_rates(spark, folder):
    counts = metrics.confusion(decisions(spark, folder), F.col("y"), F.col("action") >= 1, by=["phase"])
    return metrics.with_reported_rates(counts)


def a09_quality_rates_labels(spark, folder):
    return metrics.with_reported_rates(metrics.confusion(labelled_documents(spark, folder), F.col("y"), F.col("action") >= 1))


def a10_family_breakdown(spark, folder):
    return fused_family_report(spark, folder)


def a11_action_level_counts(spark, folder):
    return metrics.action_level_counts(decisions(spark, folder), F.col("action"), F.col("threat_score"))


def a12_actions_by_load(spark, folder):
    return metrics.actions_by_load(decisions(spark, folder), "analyst_load", F.col("action")).select(
        "analyst_load", "dismiss", "monitor", "escalate"
    )


def a12_actions_by_load_policy(spark, folder):
    return metrics.actions_by_load_from_policy(learned_policy(spark, folder)).select(
        "analyst_load", "dismiss", "monitor", "escalate"
    )


def a13_action_proportions(spark, folder):
    shares = metrics.actions_by_load(decisions(spark, folder), "analyst_load", F.col("action"))
    names = ["dismiss_pct", "monitor_pct", "escalate_pct"]
    return rounded(shares.select("analyst_load", *names), names)


def a14_label_action_matrix(spark, folder):
    return metrics.label_action_matrix(decisions(spark, folder), "y", F.col("action"))


def a15_score_histogram(spark, folder):
    df = table(spark, folder, "orders").select(
        (F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )
    # Scores with many distinct values; the flow scores have a hundred.
    wide = metrics.score_histogram(df, F.round("score", 3), F.col("y")).withColumn("table", F.lit("orders"))
    flow_scores = metrics.score_histogram(decisions(spark, folder), F.col("threat_score"), F.col("y"))
    return wide.unionByName(flow_scores.withColumn("table", F.lit("flows")))


def a16_reward_distribution(spark, folder):
    return rounded(
        metrics.reward_distribution(decisions(spark, folder), F.col("action"), F.col("reward")),
        ["low", "q1", "median", "q3", "high", "whisker_low", "whisker_high"], 3,
    )


def a17_outcome_share(spark, folder):
    return metrics.outcome_share(decisions(spark, folder), F.col("y"), F.col("action"))


def a18_kpi_counters(spark, folder):
    return metrics.kpi_counters(decisions(spark, folder), F.col("y"), F.col("action"))


def learned_policy(spark, folder):
    """Policy folded from the logged decisions, starting empty."""
    placed = threat_density(decisions(spark, folder), "threat_score", block_rows=BLOCK, dense=True)
    state = triage.state_columns(F.col("threat_score"), F.col("analyst_load"), F.col("density_after"), F.col("dst_port"))
    # The fold reads its updates three times; the density windows run once.
    updates = durable(placed.withColumns(state).select(*policy.CELL, "reward", "step"))
    return policy.fold_updates(updates, policy.empty_policy(spark), block_rows=BLOCK)


def a19_policy_heatmap(spark, folder):
    return rounded(metrics.policy_heatmap(learned_policy(spark, folder)), ["best_q"], 3)


def a20_chunk_quality(spark, folder):
    quality = metrics.chunk_quality(items(spark, folder), "month", F.col("predicted"), F.col("y"))
    return rounded(quality, ["accuracy", "threat_rate"], 6)


def a21_calibration_summary(spark, folder):
    df = decisions(spark, folder)
    return rounded(metrics.calibration_summary(df, F.col("threat_score"), F.col("y")), ["label_rate", "mean_score"], 5)


def a22_distinct_sources(spark, folder):
    return behaviour.tracked_sources(flows(spark, folder))


def a22_sketched_sources(spark, folder):
    """Sketches stored per chunk and read back, united without the flows; checked against the exact count."""
    rows = flows(spark, folder)
    stored = durable(behaviour.source_sketches(rows, ["chunk"]), "source-sketches")
    united = behaviour.united_sources(stored)
    exact = behaviour.tracked_sources(rows).withColumnRenamed("sources", "exact")
    bound = behaviour.relative_error_bound()
    return united.crossJoin(exact).select(  # one row each
        "sketches", F.col("exact").alias("sources"),
        (F.abs(F.col("sources") - F.col("exact")) <= F.lit(bound) * F.col("exact")).alias("within_bound"),
    )


def a23_summary_card(spark, folder):
    card = metrics.summary_card(decisions(spark, folder), F.col("y"), F.col("action"), F.col("reward"))
    return rounded(rounded(card, ["f1"]), ["total_reward"], 2)


def a24_dataset_inventory(spark, folder):
    docs = table(spark, folder, "documents")
    fmt = F.when(F.length("source") > 4, "csv").otherwise("parquet")
    return metrics.dataset_inventory(docs, F.col("lang"), fmt, F.col("source"))


def l08_heldout_accuracy(spark, folder):
    held = metrics.heldout_accuracy(items(spark, folder), "month", F.col("predicted"), F.col("y"))
    return rounded(held, ["accuracy"], 6)


QUERIES = {f.__name__: f for f in (
    a01_label_distribution, a02_class_distribution, a03_label_medians, a04_class_statistics, a05_scaler_statistics,
    a06_detector_confusion, a07_agent_confusion_strict, a08_agent_confusion_pipeline, a09_quality_rates,
    a09_quality_rates_labels, a10_family_breakdown, a11_action_level_counts, a12_actions_by_load,
    a12_actions_by_load_policy, a13_action_proportions, a14_label_action_matrix, a15_score_histogram,
    a16_reward_distribution, a17_outcome_share, a18_kpi_counters, a19_policy_heatmap, a20_chunk_quality,
    a21_calibration_summary, a22_distinct_sources, a22_sketched_sources, a23_summary_card, a24_dataset_inventory, l08_heldout_accuracy,
)}

_TRUTH = "(CASE WHEN k % 9 = 0 THEN NULL WHEN lower(trim(label)) = 'benign' THEN 0 ELSE 1 END)"
_DETECTED = "threat_score > (CASE WHEN dst_port IN (80,443,3000,5000,8000,8080,8443,8888) THEN 0.35e0 ELSE 0.5e0 END)"
_BY_ACTION = "count(*) FILTER (WHERE action = 0) AS dismiss, count(*) FILTER (WHERE action = 1) AS monitor, count(*) FILTER (WHERE action = 2) AS escalate"

# Learned policy: density including the current row, updates folded by window products.
DENSITY_SQL = DECISIONS_SQL + f""",
dense AS (SELECT *,
    coalesce(avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), 0e0) AS density_before,
    avg(threat_score) OVER (ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS density_after
  FROM decisions)"""
LEARNED_SQL = DENSITY_SQL + f""",
placed AS (SELECT step, reward, action, CAST(floor(least(19e0, threat_score*20)) AS INT) AS tb,
    CAST(floor(least(19e0, analyst_load*20)) AS INT) AS lb, CAST(floor(least(4e0, density_after*5)) AS INT) AS db,
    {PORT_CLASS_SQL} AS pb FROM dense),
numbered AS (SELECT *, row_number() OVER (PARTITION BY tb, lb, db, pb, action ORDER BY step) AS v FROM placed),
rated AS (SELECT *, 0.15e0 / (1 + 0.001e0 * v) AS lr FROM numbered),
weighted AS (SELECT *, coalesce(exp(sum(ln(1 - lr)) OVER (PARTITION BY tb, lb, db, pb, action ORDER BY step
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1e0) AS later FROM rated),
learned AS (SELECT tb, lb, db, pb, action, sum(reward * lr * later) AS q, count(*) AS visits
  FROM weighted GROUP BY ALL)"""

ORACLES = {
    "a01_label_distribution": FLOWS_SQL + "SELECT lower(trim(label)) AS label, count(*) AS n FROM flows GROUP BY 1",
    "a02_class_distribution": FLOWS_SQL + f"""
SELECT family, is_attack, n, CAST(sum(n) OVER (PARTITION BY is_attack) AS BIGINT) AS class_n,
  round(CAST(n AS DOUBLE) / sum(n) OVER (), 6) AS share
FROM (SELECT CASE WHEN {Y_SQL} = 0 THEN 'Benign' ELSE {FAMILY_SQL} END AS family, {Y_SQL} AS is_attack, count(*) AS n
  FROM flows GROUP BY 1, 2)""",
    "a03_label_medians": FLOWS_SQL + f"""
, named AS (SELECT *, CASE WHEN lower(trim(label)) = 'benign' THEN 'benign' ELSE {FAMILY_SQL} END AS fam FROM flows)
""" + " UNION ALL ".join(
        f"SELECT fam AS label, '{c}' AS feature, count(*) AS n, round(median(CAST({c} AS DOUBLE)), 4) AS median FROM named GROUP BY fam"
        for c in FLOW_FEATURES
    ),
    "a04_class_statistics": ITEMS_SQL + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(round_even(avg({c}) FILTER (WHERE y = 0), 2), 1) AS benign_mean,
  round(round_even(stddev_samp({c}) FILTER (WHERE y = 0), 2), 1) AS benign_std,
  round(round_even(avg({c}) FILTER (WHERE y = 1), 2), 1) AS attack_mean,
  round(round_even(stddev_samp({c}) FILTER (WHERE y = 1), 2), 1) AS attack_std FROM items"""
        for c in ITEM_FEATURES
    ),
    "a05_scaler_statistics": ITEMS_SQL + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM items" for c in ITEM_FEATURES
    ),
    "a06_detector_confusion": FLOWS_SQL + f"SELECT {confusion_sql(_DETECTED, y='truth')} FROM (SELECT *, {_TRUTH} AS truth FROM flows)",
    "a07_agent_confusion_strict": DECISIONS_SQL + f"SELECT {confusion_sql('action >= 1')} FROM decisions",
    "a08_agent_confusion_pipeline": DECISIONS_SQL + f"SELECT {confusion_sql('action >= 1', 'action = 2')} FROM decisions",
    "a09_quality_rates": DECISIONS_SQL + rates_sql(f"SELECT phase, {confusion_sql('action >= 1')} FROM decisions GROUP BY phase"),
    "a09_quality_rates_labels": rates_sql(f"SELECT {confusion_sql('quality = 0', y='toxic')} FROM labels"),
    "a10_family_breakdown": WINDOW_SQL + ", " + f"""
detected AS (SELECT {FAMILY_SQL} AS family, threat_score, {Y_SQL} AS y,
  greatest(threat_score, score) > (CASE WHEN dst_port IN (80,443,3000,5000,8000,8080,8443,8888) THEN 0.35e0 ELSE 0.5e0 END) AS hit
  FROM scored)
""" + rates_sql(f"SELECT trim(family) AS label, count(*) AS n, CAST(round_even(avg(threat_score), 4) AS DOUBLE) AS avg_score, {confusion_sql('hit')} FROM detected GROUP BY 1"),
    "a11_action_level_counts": DECISIONS_SQL + f"SELECT {ACTION_SQL} AS action, {LEVEL_SQL} AS level, count(*) AS n FROM decisions GROUP BY 1, 2",
    "a12_actions_by_load": DECISIONS_SQL + f"SELECT analyst_load, {_BY_ACTION} FROM decisions GROUP BY 1",
    "a12_actions_by_load_policy": DECISIONS_SQL + f"SELECT analyst_load, {_BY_ACTION} FROM decisions GROUP BY 1",
    "a13_action_proportions": DECISIONS_SQL + """
SELECT analyst_load, round(100e0 * count(*) FILTER (WHERE action = 0) / count(*), 4) AS dismiss_pct,
  round(100e0 * count(*) FILTER (WHERE action = 1) / count(*), 4) AS monitor_pct,
  round(100e0 * count(*) FILTER (WHERE action = 2) / count(*), 4) AS escalate_pct FROM decisions GROUP BY 1""",
    "a14_label_action_matrix": DECISIONS_SQL + f"SELECT y, {_BY_ACTION} FROM decisions GROUP BY 1",
    "a15_score_histogram": DECISIONS_SQL + """
SELECT round(o_totalprice / 500000e0, 3) AS score, count(*) FILTER (WHERE o_orderstatus <> 'F') AS benign,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS attack, 'orders' AS "table" FROM orders GROUP BY 1
UNION ALL SELECT threat_score, count(*) FILTER (WHERE y = 0), count(*) FILTER (WHERE y = 1), 'flows' FROM decisions GROUP BY 1""",
    "a16_reward_distribution": DECISIONS_SQL + f"""
, r AS (SELECT {ACTION_SQL} AS action, CAST(reward AS DOUBLE) AS r FROM decisions),
b AS (SELECT action, count(*) AS n, min(r) AS low, quantile_cont(r, 0.25) AS q1, quantile_cont(r, 0.5) AS median,
  quantile_cont(r, 0.75) AS q3, max(r) AS high FROM r GROUP BY 1)
SELECT b.action, n, round(low, 3) AS low, round(q1, 3) AS q1, round(median, 3) AS median, round(q3, 3) AS q3, round(high, 3) AS high,
  round(min(r.r), 3) AS whisker_low, round(max(r.r), 3) AS whisker_high
FROM b JOIN r ON b.action = r.action AND r.r BETWEEN q1 - 1.5e0*(q3-q1) AND q3 + 1.5e0*(q3-q1) GROUP BY ALL""",
    "a17_outcome_share": DECISIONS_SQL + f"""
SELECT outcome, n, CAST(floor(100e0 * n / sum(n) OVER ()) AS INT) AS pct FROM (
  SELECT concat({ACTION_SQL}, ' (', CASE WHEN y = 1 THEN 'Threat' ELSE 'Benign' END, ')') AS outcome, count(*) AS n
  FROM decisions GROUP BY 1)""",
    "a18_kpi_counters": DECISIONS_SQL + """
SELECT count(*) AS events_captured, count(*) FILTER (WHERE y = 1) AS active_threats,
  count(*) FILTER (WHERE y = 1 AND action = 0) AS failed_requests, count(*) FILTER (WHERE action >= 1) AS flagged_ips FROM decisions""",
    "a19_policy_heatmap": LEARNED_SQL + """
, m AS (SELECT tb, lb, CAST(sum(visits) AS BIGINT) AS visits,
  coalesce(sum(q) FILTER (WHERE action = 0), 0e0)/15 AS q0, coalesce(sum(q) FILTER (WHERE action = 1), 0e0)/15 AS q1,
  coalesce(sum(q) FILTER (WHERE action = 2), 0e0)/15 AS q2 FROM learned GROUP BY 1, 2)
SELECT tb, lb, visits, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS best_action,
  round(greatest(q0, q1, q2), 3) AS best_q FROM m""",
    "a20_chunk_quality": ITEMS_SQL + """
SELECT month, count(*) AS n, round(avg(CASE WHEN predicted = y THEN 1e0 ELSE 0e0 END), 6) AS accuracy,
  round(avg(y), 6) AS threat_rate FROM items GROUP BY 1""",
    "a21_calibration_summary": DECISIONS_SQL + "SELECT count(*) AS n, round(avg(y), 5) AS label_rate, round(avg(threat_score), 5) AS mean_score FROM decisions",
    "a22_distinct_sources": FLOWS_SQL + "SELECT count(DISTINCT src_ip) AS sources FROM flows",
    "a22_sketched_sources": FLOWS_SQL + "SELECT count(DISTINCT coalesce(CAST(chunk AS VARCHAR), '-')) AS sketches, count(DISTINCT src_ip) AS sources, TRUE AS within_bound FROM flows",
    "a23_summary_card": DECISIONS_SQL + """
, c AS (SELECT count(*) FILTER (WHERE y=1 AND action>=1) AS tp, count(*) FILTER (WHERE y=0 AND action=2) AS fp,
  count(*) FILTER (WHERE y=1 AND action=0) AS fn, sum(reward) AS total, count(*) AS steps FROM decisions),
r AS (SELECT CAST(round_even(CAST(tp AS DOUBLE)/greatest(tp+fp,1), 4) AS DOUBLE) AS precision,
  CAST(round_even(CAST(tp AS DOUBLE)/greatest(tp+fn,1), 4) AS DOUBLE) AS recall, total, steps FROM c)
SELECT precision, recall, round(2*precision*recall/greatest(precision+recall, 1e-9), 4) AS f1, round(total, 2) AS total_reward, steps FROM r""",
    "a24_dataset_inventory": """
SELECT dataset, format, count(*) AS files, CAST(sum(n) AS BIGINT) AS total_rows FROM (
  SELECT lang AS dataset, CASE WHEN length(source) > 4 THEN 'csv' ELSE 'parquet' END AS format, source, count(*) AS n
  FROM documents GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "l08_heldout_accuracy": ITEMS_SQL + """
SELECT count(*) AS n, count(*) FILTER (WHERE predicted = y) AS correct,
  round(avg(CASE WHEN predicted = y THEN 1e0 ELSE 0e0 END), 6) AS accuracy
FROM items WHERE month IN (SELECT DISTINCT month FROM items ORDER BY month DESC LIMIT 2)""",
}
