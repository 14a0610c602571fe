"""Round trips through files: captures in two formats, documents, versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import flow
from flowtriage.operators import behaviour, models, policy
from flowtriage.plans.aggregates import LEARNED_SQL, learned_policy
from flowtriage.plans.models import ORACLES as MODEL_SQL
from flowtriage.plans.samples import ORACLES as SAMPLE_SQL
from flowtriage.plans.scans import CANONICAL, LONG_HEADERS, SNAKE_HEADERS, in_dialect
from flowtriage.plans.tables import ACTION_SQL, DECISIONS_SQL, FLOWS_SQL, decisions, flows
from flowtriage.plans.windows import BLOCK
from flowtriage.sources import readers, sinks
from flowtriage.sources.workspace import durable, new_folder


def _captures(spark, folder):
    """Even flows as snake_case CSV, odd ones as long-name Parquet, in one folder."""
    target = new_folder(spark, "captures")
    snake = in_dialect(spark, folder, {**SNAKE_HEADERS, "src_port": "flow_id"})
    long = in_dialect(spark, folder, {**LONG_HEADERS, "Src Port": "flow_id"})
    snake.filter("flow_id % 2 = 0").drop("flow_id").write.mode("append").csv(target, header=True)
    long.filter("flow_id % 2 = 1").drop("flow_id").write.mode("append").parquet(target)
    return target


def _shown(df):
    """Captured columns; the flow id travels as the source port."""
    return df.select(
        F.col("src_port").cast("long").alias("flow_id"),
        F.element_at(F.split("source_file", r"\."), -1).alias("kind"),
        *[F.round(F.col(f"`{f}`").cast("double"), 2).alias(c) for f, c in CANONICAL.items()],
        F.trim("Label").alias("label"),
        "coverage",
    )


def _only(spark, folder, suffix):
    target = _captures(spark, folder)
    names = [p.rsplit("/", 1)[-1] for p in readers.list_files(spark, target) if p.endswith(suffix)]
    return readers.read_flows(spark, target, allow=names, uniform=["part-*"])


def s02_csv_scan(spark, folder):
    """Every flow written as snake_case CSV, then read back."""
    target = new_folder(spark, "csv")
    in_dialect(spark, folder, {**SNAKE_HEADERS, "src_port": "flow_id"}).drop("flow_id").write.csv(target, header=True)
    return _shown(readers.read_flows(spark, target, uniform=["part-*"]))


def s03_mixed_directory(spark, folder):
    return _shown(readers.read_flows(spark, _captures(spark, folder), uniform=["part-*"]))


def s03_shuffled_headers(spark, folder):
    """CSV files with the same columns in two orders, mapped by name."""
    target = new_folder(spark, "shuffled")
    snake = in_dialect(spark, folder, {**SNAKE_HEADERS, "src_port": "flow_id"})
    names = [c for c in snake.columns if c != "flow_id"]
    for part, order in ((0, names), (1, names[::-1])):
        snake.filter(F.col("flow_id") % 2 == part).select(*order).write.mode("append").csv(target, header=True)
    return _shown(readers.read_flows(spark, target)).drop("kind")


def s06_soc_events(spark, folder):
    """Events as a SOC export: a CSV file, read back with parsed times and scored by the additive rules."""
    path = new_folder(spark, "soc")
    events = flows(spark, folder)
    given = {
        "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "event_type": F.when(F.col("k") % 3 == 0, "service_install").otherwise("logon_failure"),
        "severity": (F.col("k") % 5).cast("string"),
        "is_internal_src": (F.col("k") % 2).cast("string"),
        "src_ip": F.col("src_ip"),
        "msg": F.concat(F.lit("flow="), F.col("flow_id").cast("string"), F.lit("; country="), F.when(F.col("k") % 7 == 0, "CN").otherwise("DE")),
    }
    row = [given.get(f.name, F.lit(None)).cast("string").alias(f.name) for f in S.SOC_EVENT_SCHEMA]
    events.select(*row).write.csv(path, header=True)
    read, _ = readers.read_soc_events(spark, path)
    country = flow.soc_message_field(F.col("msg"), "country")
    score = flow.suspicion_score(
        F.col("severity").cast("int"), F.col("event_type"), F.col("is_internal_src").cast("int"), country, F.lit("x"),
    )
    return read.select(
        flow.soc_message_field(F.col("msg"), "flow").cast("long").alias("flow_id"),
        F.unix_timestamp("timestamp").alias("second"), country.alias("country"), F.round(score, 2).alias("suspicion"),
    )


def s07_upload(spark, folder):
    """One CSV table as a user would upload it."""
    target = new_folder(spark, "upload")
    snake = in_dialect(spark, folder, {**SNAKE_HEADERS, "src_port": "flow_id"}).drop("flow_id")
    snake.coalesce(1).write.csv(target, header=True)  # an upload is one file
    (path,) = readers.list_files(spark, target)
    return _shown(readers.read_upload(spark, path)).drop("kind")


def s10_stored_models(spark, folder):
    """Scaler and calibrator stored and loaded; loaded ones equal those fitted."""
    root = new_folder(spark, "models")
    rows = decisions(spark, folder)
    mean, scale = rows.agg(F.avg("threat_score"), F.stddev_pop("threat_score")).first()
    sinks.load_scaler(spark, f"{root}/scaler", lambda: {"threat_score": (mean, scale)})
    stored = sinks.load_scaler(spark, f"{root}/scaler", lambda: {})
    fit = lambda: models.fit_calibrator(rows, F.col("threat_score"), F.col("y"))
    sinks.load_calibrator(f"{root}/calibrator", fit)
    model, loaded = sinks.load_calibrator(f"{root}/calibrator", fit)
    scores = rows.select("threat_score").distinct()
    known = stored["threat_score"]
    return models.calibrate(scores, model, "threat_score", "calibrated").select(
        "threat_score", F.round("calibrated", 5).alias("calibrated"), F.lit(loaded).alias("loaded"),
        F.round((F.col("threat_score") - known[0]) / known[1], 4).alias("scaled"),
    )


def s04_allow_list(spark, folder):
    return _shown(_only(spark, folder, ".parquet"))


def _log(spark, folder):
    return durable(
        decisions(spark, folder).select(
            "step", "threat_score", "action", F.col("y").alias("true_label"), "reward", "analyst_load",
            "dst_port", F.floor("flow_duration").cast("long").alias("flow_dur"),
        )
    )


def _stored_state(spark, folder):
    path = new_folder(spark, "state")
    sinks.write_json(sinks.run_state(_log(spark, folder)), path)
    return readers.read_state(spark, path)


def s08_state_counters(spark, folder):
    return _stored_state(spark, folder).select("events_captured", "failed_requests", "active_threats", "flagged_ips")


def s12_state_log(spark, folder):
    return readers.state_log(_stored_state(spark, folder)).select("step", "threat_score", "action", "true_label")


def s09_policy_store(spark, folder):
    store = new_folder(spark, "policy")
    sinks.save_policy(policy.empty_policy(spark), store)
    sinks.save_policy(learned_policy(spark, folder), store)
    loaded, _ = sinks.load_policy(spark, store)
    return loaded.select(
        F.count("*").alias("cells"), policy.policy_steps(loaded).alias("total_steps"), F.round(F.sum("q"), 2).alias("sum_q")
    )


def s11_behaviour_tail(spark, folder):
    store = new_folder(spark, "tails")
    sinks.save_version(behaviour.behaviour_tail(flows(spark, folder), 5, block_rows=BLOCK), store, 0)
    return sinks.load_version(spark, store)[0].select("src_ip", "step", "dst_port")


QUERIES = {f.__name__: f for f in (
    s02_csv_scan, s03_mixed_directory, s03_shuffled_headers, s06_soc_events, s07_upload, s10_stored_models, s04_allow_list, s08_state_counters, s09_policy_store, s11_behaviour_tail, s12_state_log,
)}

_COLUMNS = ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 2) AS {c}" for c in CANONICAL.values())
_CAPTURED = FLOWS_SQL + f"""
SELECT flow_id, CASE WHEN flow_id % 2 = 0 THEN 'csv' ELSE 'parquet' END AS kind, {_COLUMNS}, trim(label) AS label,
  CAST(6 AS INT) AS coverage FROM flows"""

_ALL_CAPTURED = _CAPTURED.replace("CASE WHEN flow_id % 2 = 0 THEN 'csv' ELSE 'parquet' END AS kind, ", "")

ORACLES = {
    "s02_csv_scan": _CAPTURED.replace("CASE WHEN flow_id % 2 = 0 THEN 'csv' ELSE 'parquet' END AS kind", "'csv' AS kind"),
    "s03_mixed_directory": _CAPTURED,
    "s03_shuffled_headers": _ALL_CAPTURED,
    "s06_soc_events": FLOWS_SQL + """
SELECT flow_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS second, CASE WHEN k % 7 = 0 THEN 'CN' ELSE 'DE' END AS country,
  round(least(0.95e0, 0.04e0 + CASE WHEN k % 5 >= 3 THEN 0.15e0 ELSE 0 END + CASE WHEN k % 5 = 4 THEN 0.10e0 ELSE 0 END
    + CASE WHEN k % 3 = 0 THEN 0.35e0 ELSE 0 END + CASE WHEN k % 2 = 0 THEN 0.05e0 ELSE 0 END
    + CASE WHEN k % 7 = 0 THEN 0.10e0 ELSE 0 END), 2) AS suspicion FROM flows""",
    "s07_upload": _ALL_CAPTURED,
    "s10_stored_models": MODEL_SQL["l06_isotonic_calibration"].replace(
        "SELECT s AS threat_score, round(calibrated, 5) AS calibrated FROM fits",
        """SELECT s AS threat_score, round(calibrated, 5) AS calibrated, true AS loaded,
  round((s - (SELECT avg(threat_score) FROM decisions)) / (SELECT stddev_pop(threat_score) FROM decisions), 4) AS scaled FROM fits"""),
    "s04_allow_list": _CAPTURED + " WHERE flow_id % 2 = 1",
    "s08_state_counters": DECISIONS_SQL + """
SELECT count(*) AS events_captured, count(*) FILTER (WHERE y = 1 AND action = 0) AS failed_requests,
  count(*) FILTER (WHERE y = 1) AS active_threats, count(*) FILTER (WHERE action >= 1) AS flagged_ips FROM decisions""",
    "s09_policy_store": LEARNED_SQL + "SELECT count(*) AS cells, CAST(sum(visits) AS BIGINT) AS total_steps, round(sum(q), 2) AS sum_q FROM learned",
    "s11_behaviour_tail": FLOWS_SQL + """
SELECT src_ip, step, dst_port FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY step DESC) AS rn FROM flows) WHERE rn <= 5""",
    "s12_state_log": SAMPLE_SQL["t05_representative_log"].replace(
        "SELECT step, threat_score, action, y AS true_label FROM picked", f"SELECT step, threat_score, {ACTION_SQL} AS action, y AS true_label FROM picked"
    ).replace("SELECT step, threat_score, action, y FROM r, room", f"SELECT step, threat_score, {ACTION_SQL}, y FROM r, room"),
}
