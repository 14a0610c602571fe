"""Scans, header handling, cleaning and file-level selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage import schema as S
from flowtriage.functions import flow
from flowtriage.operators import clean, sampling
from flowtriage.plans.tables import FLOWS_SQL, flows, table

# Columns of the flow table under their canonical names.
CANONICAL = {
    "Dst Port": "dst_port",
    "Flow Duration": "flow_duration",
    "Tot Fwd Pkts": "tot_fwd_pkts",
    "TotLen Fwd Pkts": "totlen_fwd_pkts",
    "Pkt Size Avg": "pkt_size_avg",
    "Flow Pkts/s": "flow_pkts_s",
}
LONG_HEADERS = {
    " Destination Port": "dst_port",
    "Flow Duration ": "flow_duration",
    "Total Fwd Packets": "tot_fwd_pkts",
    "Fwd Packets Length Total": "totlen_fwd_pkts",
    "AVG PACKET SIZE": "pkt_size_avg",
    " Flow Packets/s": "flow_pkts_s",
}
SNAKE_HEADERS = {
    "dst_port": "dst_port",
    "duration": "flow_duration",
    "fwd_packets_count": "tot_fwd_pkts",
    "fwd_total_payload_bytes": "totlen_fwd_pkts",
    "avg_segment_size": "pkt_size_avg",
    "packets_rate": "flow_pkts_s",
}


def in_dialect(spark: SparkSession, folder: str, headers: dict[str, str]) -> DataFrame:
    base = flows(spark, folder)
    return base.select("flow_id", *[F.col(c).alias(h) for h, c in headers.items()], F.col("label").alias("Label"))


def _canonical_subset(df: DataFrame) -> DataFrame:
    """Features the flow table supplies, rounded for comparison."""
    return df.select(
        "flow_id",
        *[F.round(F.col(f"`{f}`").cast("double"), 2).alias(c) for f, c in CANONICAL.items()],
        F.col("Label").alias("label"),
    )


_SUBSET_SQL = ", ".join(
    f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 2) AS {c}" for c in CANONICAL.values()
)


def s01_parquet_scan(spark, folder):
    items = table(spark, folder, "lineitem")
    return items.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty")
    )


def s05_cap_per_file(spark, folder):
    capped = sampling.cap_per_file(flows(spark, folder), "chunk", "flow_id", 700)
    return capped.select("chunk", "flow_id", "threat_score")


def p01_header_normalise(spark, folder):
    named = clean.with_normalised_headers(in_dialect(spark, folder, {" DST PORT ": "dst_port", "Flow Duration": "flow_duration"}))
    return named.select("flow_id", F.col("`dst port`").alias("dst_port"), F.round("`flow duration`", 2).alias("flow_duration"))


def p02_duplicate_columns(spark, folder):
    base = flows(spark, folder)
    # The port occurs three times: twice under one header, once as another dialect.
    doubled = base.select("flow_id", F.col("dst_port").alias("Dst Port"), (F.col("dst_port") + 1).alias("dst port "),
                          (F.col("dst_port") + 2).alias("destination port"), "label")
    return clean.with_normalised_headers(doubled).select("flow_id", F.col("`dst port`").alias("dst_port"), "label")


def p03_alias_rename(spark, folder):
    named = clean.with_normalised_headers(in_dialect(spark, folder, SNAKE_HEADERS))
    return named.select("flow_id", *[F.round(F.col(f"`{f.lower()}`").cast("double"), 6).alias(c) for f, c in CANONICAL.items()])


def p04_feature_ladder(spark, folder):
    raw = in_dialect(spark, folder, LONG_HEADERS)
    return _canonical_subset(clean.canonicalise(raw, keep={"flow_id": "flow_id"}))


def p05_feature_fallback(spark, folder):
    raw = in_dialect(spark, folder, SNAKE_HEADERS)
    plain = clean.canonicalise(raw, keep={"flow_id": "flow_id"})
    filled = clean.canonicalise(raw, fallbacks=True, keep={"flow_id": "flow_id"})
    column = F.col("`Fwd Act Data Pkts`").cast("double")
    return plain.select("flow_id", F.lit(False).alias("fallback"), column.alias("act_data_pkts")).unionByName(
        filled.select("flow_id", F.lit(True).alias("fallback"), column.alias("act_data_pkts"))
    )


def p06_label_default(spark, folder):
    raw = in_dialect(spark, folder, LONG_HEADERS).drop("Label")
    return clean.canonicalise(raw, keep={"flow_id": "flow_id"}).select("flow_id", F.col("Label").alias("label"))


# Every seventh value broken in one of four ways, in both engines.
_BROKEN = {
    1: "CAST('Infinity' AS DOUBLE)", 2: "CAST('-Infinity' AS DOUBLE)", 3: "CAST('NaN' AS DOUBLE)", 4: "NULL",
}
_BROKEN_SQL = "CASE " + " ".join(f"WHEN flow_id % 7 = {k} THEN {v}" for k, v in _BROKEN.items()) + " ELSE flow_duration END"


def p07_bad_row_filter(spark, folder):
    raw = flows(spark, folder).select("flow_id", F.expr(_BROKEN_SQL).alias("Flow Duration"), F.col("dst_port").alias("Dst Port"), F.col("label").alias("Label"))
    kept = clean.canonicalise(raw, keep={"flow_id": "flow_id"})
    return kept.select("flow_id", F.round(F.col("`Flow Duration`").cast("double"), 2).alias("flow_duration"))


def p08_fixed_projection(spark, folder):
    raw = in_dialect(spark, folder, SNAKE_HEADERS)
    return clean.canonicalise(raw, keep={"flow_id": "flow_id"}).select("flow_id", *[f"`{f}`" for f in S.FEATURES])


_SUPPLIED = {f: f"CAST({c} AS FLOAT)" for f, c in CANONICAL.items()}
_P08_SQL = ", ".join(f"{_SUPPLIED.get(f, 'CAST(0 AS FLOAT)')} AS \"{f}\"" for f in S.FEATURES)


def p09_downcast(spark, folder):
    return flows(spark, folder).select("flow_id", F.col("pkt_size_avg").cast("float").alias("pkt_size_avg"))


def p12_feature_coverage(spark, folder):
    parts = None
    for name, headers in (("canonical", {f: c for f, c in CANONICAL.items()}), ("long", LONG_HEADERS), ("snake", SNAKE_HEADERS)):
        raw = in_dialect(spark, folder, headers)
        part = raw.groupBy().agg(F.count("*").alias("n")).select(
            F.lit(name).alias("dialect"), F.lit(clean.feature_coverage(raw.columns)).alias("coverage"), "n"
        )
        parts = part if parts is None else parts.unionByName(part)
    return parts


def p13_coverage_filter(spark, folder):
    covered = clean.coverage_filter(flows(spark, folder), F.col("label"), F.col("k") % 30)
    return covered.groupBy(F.lower(F.trim("label")).alias("label")).agg(F.count("*").alias("n"), F.min(F.col("k") % 30).alias("least"))


_MESSY_SQL = (
    "CASE k % 6 WHEN 0 THEN 'n/a' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN NULL "
    "WHEN 4 THEN '-Infinity' ELSE CAST(k AS VARCHAR(10)) END"
)


def p14_lenient_numbers(spark, folder):
    messy = flows(spark, folder).select("flow_id", F.expr(_MESSY_SQL).alias("raw"))
    return messy.select("flow_id", flow.lenient_double(F.col("raw")).alias("value"))


def p21_before_after(spark, folder):
    raw = flows(spark, folder).select("flow_id", "dst_port", F.expr(_BROKEN_SQL).alias("flow_duration"), "tot_fwd_pkts", "label")
    return clean.before_after_sample(raw, ["dst_port", "flow_duration", "tot_fwd_pkts"], "flow_id", "label")


def j04_realign_raw(spark, folder):
    raw = flows(spark, folder).select("flow_id", "src_ip", F.expr(_BROKEN_SQL).alias("Flow Duration"), F.col("dst_port").alias("Dst Port"), F.col("label").alias("Label"))
    kept = clean.canonicalise(raw, keep={"flow_id": "flow_id", "src_ip": "src_ip"})
    return kept.select("flow_id", "src_ip", F.col("`Dst Port`").cast("int").alias("dst_port"))


QUERIES = {f.__name__: f for f in (
    s01_parquet_scan, s05_cap_per_file, p01_header_normalise, p02_duplicate_columns, p03_alias_rename,
    p04_feature_ladder, p05_feature_fallback, p06_label_default, p07_bad_row_filter, p08_fixed_projection,
    p09_downcast, p12_feature_coverage, p13_coverage_filter, p14_lenient_numbers, p21_before_after, j04_realign_raw,
)}

_KEPT = f"isfinite({_BROKEN_SQL})"

ORACLES = {
    "s01_parquet_scan": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1",
    "s05_cap_per_file": FLOWS_SQL + """
SELECT chunk, flow_id, threat_score FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY flow_id) AS rn FROM flows) WHERE rn <= 700""",
    "p01_header_normalise": FLOWS_SQL + "SELECT flow_id, dst_port, round(flow_duration, 2) AS flow_duration FROM flows",
    "p02_duplicate_columns": FLOWS_SQL + "SELECT flow_id, dst_port, label FROM flows",
    "p03_alias_rename": FLOWS_SQL + "SELECT flow_id, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in CANONICAL.values()) + " FROM flows",
    "p04_feature_ladder": FLOWS_SQL + f"SELECT flow_id, {_SUBSET_SQL}, label FROM flows",
    "p05_feature_fallback": FLOWS_SQL + """
SELECT flow_id, false AS fallback, 0e0 AS act_data_pkts FROM flows
UNION ALL SELECT flow_id, true, CAST(tot_fwd_pkts AS DOUBLE) FROM flows""",
    "p06_label_default": FLOWS_SQL + "SELECT flow_id, 'Unknown' AS label FROM flows",
    "p07_bad_row_filter": FLOWS_SQL + f"SELECT flow_id, round(CAST(CAST(flow_duration AS FLOAT) AS DOUBLE), 2) AS flow_duration FROM flows WHERE {_KEPT}",
    "p08_fixed_projection": FLOWS_SQL + f"SELECT flow_id, {_P08_SQL} FROM flows",
    "p09_downcast": FLOWS_SQL + "SELECT flow_id, CAST(pkt_size_avg AS FLOAT) AS pkt_size_avg FROM flows",
    "p12_feature_coverage": FLOWS_SQL + "SELECT d AS dialect, CAST(6 AS INT) AS coverage, count(*) AS n FROM flows, (VALUES ('canonical'), ('long'), ('snake')) v(d) GROUP BY 1",
    "p13_coverage_filter": FLOWS_SQL + """
SELECT lower(trim(label)) AS label, count(*) AS n, CAST(min(k % 30) AS INT) AS least FROM flows
WHERE k % 30 >= (CASE WHEN lower(trim(label)) = 'benign' THEN 20 ELSE 11 END) GROUP BY 1""",
    "p14_lenient_numbers": FLOWS_SQL + f"""
SELECT flow_id, CASE WHEN isfinite(v) THEN v ELSE 0e0 END AS value
FROM (SELECT flow_id, TRY_CAST({_MESSY_SQL} AS DOUBLE) AS v FROM flows)""",
    "p21_before_after": FLOWS_SQL + f"""
, raw AS (SELECT flow_id, dst_port, {_BROKEN_SQL} AS flow_duration, tot_fwd_pkts, label FROM flows)
(SELECT 'raw' AS view, flow_id AS row_id, CAST(dst_port AS VARCHAR) AS dst_port,
  CASE WHEN flow_duration IS NULL OR isnan(flow_duration) THEN 'NaN' WHEN isinf(flow_duration) THEN 'Inf'
    ELSE CAST(flow_duration AS VARCHAR) END AS flow_duration,
  CAST(tot_fwd_pkts AS VARCHAR) AS tot_fwd_pkts, CAST(NULL AS VARCHAR) AS is_threat FROM raw ORDER BY flow_id LIMIT 5)
UNION ALL
(SELECT 'processed', flow_id, CAST(CAST(dst_port AS DOUBLE) AS VARCHAR), CAST(round(flow_duration, 4) AS VARCHAR),
  CAST(CAST(tot_fwd_pkts AS DOUBLE) AS VARCHAR), CASE WHEN lower(trim(label)) = 'benign' THEN '0' ELSE '1' END
  FROM raw WHERE isfinite(flow_duration) ORDER BY flow_id LIMIT 5)""",
    "j04_realign_raw": FLOWS_SQL + f"SELECT flow_id, src_ip, CAST(dst_port AS INT) AS dst_port FROM flows WHERE {_KEPT}",
}
