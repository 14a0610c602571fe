"""Scaling, weighting, training, calibration and eligibility queries."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from flowtriage.functions import flow
from flowtriage.operators import boosting, metrics, models, sampling
from flowtriage.plans.aggregates import FLOW_FEATURES, ITEM_FEATURES, ITEMS_SQL, items
from flowtriage.plans.tables import DECISIONS_SQL, FLOWS_SQL, decisions, flows
from flowtriage.sources import sinks
from flowtriage.sources.workspace import checkpoint_root

DETECTOR_FEATURES = ["dst_port", *FLOW_FEATURES]


def _detector(spark, folder, name, rows, features, settings=models.DetectorSettings()):
    """Fitted once for a folder and its settings, stored, and loaded by the other queries."""
    key = hashlib.sha256(f"{folder.rstrip('/')}|{name}|{settings}".encode()).hexdigest()[:16]
    path = f"{checkpoint_root(spark).rstrip('/')}/detectors/{spark.sparkContext.applicationId}-{key}"
    return sinks.load_detector(path, lambda: models.train_detector(rows, features, "y", settings))[0]


def _flow_detector(spark, folder):
    return _detector(spark, folder, "flows", _labelled(spark, folder), DETECTOR_FEATURES)


def _item_detector(spark, folder):
    return _detector(spark, folder, "items", items(spark, folder), ITEM_FEATURES)


def _labelled(spark, folder):
    return flows(spark, folder).withColumn("y", flow.binary_label(F.col("label")))


def l01_standardise(spark, folder):
    df = models.standardise_inline(items(spark, folder), ITEM_FEATURES)
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 4).alias(c) for c in ITEM_FEATURES])


def l02_train_detector(spark, folder):
    df = items(spark, folder)
    scored = models.score_flows(df.select("y", *ITEM_FEATURES), _item_detector(spark, folder))
    return scored.groupBy("y", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("raw_score"), 3).alias("mean_score"))


def l03_class_weight(spark, folder):
    weights = models.class_weights(items(spark, folder), "y", by=["month"])
    return weights.withColumn("positive_weight", F.round("positive_weight", 5))


def l04_refit_with_holdout(spark, folder):
    """All rows in one fit, stopping early on a held-out tenth."""
    split = sampling.holdout_split(_labelled(spark, folder), "flow_id")
    settings = models.DetectorSettings(rounds=4, depth=4, eval_column="is_eval")
    model = _detector(spark, folder, "holdout", split, DETECTOR_FEATURES, settings)
    scored = models.score_flows(split, model)
    return scored.groupBy("is_eval").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("y")).cast("int")), 3).alias("accuracy"))


def l05_predict(spark, folder):
    return models.score_flows(_labelled(spark, folder), _flow_detector(spark, folder)).select("flow_id", "predicted", F.round("raw_score", 6).alias("raw_score"))


def l06_isotonic_calibration(spark, folder):
    df = decisions(spark, folder)
    model = models.fit_calibrator(df, F.col("threat_score"), F.col("y"))
    scores = df.select("threat_score").distinct()
    calibrated = models.calibrate(scores, model, "threat_score", "calibrated")
    return calibrated.select("threat_score", F.round("calibrated", 5).alias("calibrated"))


def l07_calibrated_score(spark, folder):
    df = _labelled(spark, folder)
    sample = sampling.calibration_sample(df, "chunk", "flow_id")
    model = models.fit_calibrator(sample, F.col("threat_score"), F.col("y"))
    scored = models.calibrate(df, model, "threat_score", "calibrated")
    return metrics.calibration_summary(scored, F.col("calibrated"), F.col("y")).select(
        "n", F.round("label_rate", 5).alias("label_rate"), F.round("mean_score", 4).alias("mean_score")
    )


def l09_feature_importance(spark, folder):
    return models.feature_importance(spark, _flow_detector(spark, folder), DETECTOR_FEATURES)


def l02_training_counts(spark, folder):
    """What a fit must give whatever its trees are: a score within [0, 1] and a class for each row."""
    rows = items(spark, folder).select("y", *ITEM_FEATURES)
    scored = models.score_flows(rows, _item_detector(spark, folder))
    return scored.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if(F.col("raw_score").between(0, 1)).alias("in_range"),
        F.count_if(F.col("predicted") == (F.col("raw_score") > 0.5).cast("int")).alias("consistent"),
    )


def l05_prediction_counts(spark, folder):
    """Every flow is scored once, within [0, 1], and classed by its score."""
    scored = models.score_flows(_labelled(spark, folder), _flow_detector(spark, folder))
    return scored.groupBy("dst_port").agg(
        F.count_distinct("flow_id").alias("n"), F.count_if(F.col("raw_score").between(0, 1)).alias("in_range"),
        F.count_if(F.col("predicted") == (F.col("raw_score") > 0.5).cast("int")).alias("consistent"),
    )


def l09_importance_total(spark, folder):
    """Importances are not negative and sum to one."""
    found = models.feature_importance(spark, _flow_detector(spark, folder), DETECTOR_FEATURES)
    return found.agg(F.round(F.sum("importance"), 6).alias("total"), (F.min("importance") >= 0).alias("none_negative"))


def l04_holdout_counts(spark, folder):
    """Rows on each side of the split that a refit with a hold-out uses."""
    return l04_refit_with_holdout(spark, folder).select("is_eval", "n", F.col("accuracy").between(0, 1).alias("in_range"))


def l10_route_counts(spark, folder):
    """Every flow gets a score within [0, 1] from the detector of its route."""
    return l10_specialist_detectors(spark, folder).select("route", "n", F.col("mean_score").between(0, 1).alias("in_range"))


def t03_top_importance(spark, folder):
    return models.feature_importance(spark, _item_detector(spark, folder), ITEM_FEATURES, top=5)


def l10_specialist_detectors(spark, folder):
    """A detector per route, its calibrator where eligible, every flow scored once."""
    df = _labelled(spark, folder).withColumn("route", models.route([F.col("dst_port")]))
    fitted, calibrators = {}, {}
    for name in ("main", "web", "auth"):
        rows = models.route_training_rows(df, name, "dst_port")
        fitted[name] = _detector(spark, folder, f"route-{name}", rows, DETECTOR_FEATURES)
        raw = models.score_flows(sampling.calibration_sample(rows, "chunk", "flow_id"), fitted[name])
        if models.can_calibrate(raw, F.col("y")).first()["eligible"]:
            calibrators[name] = models.fit_calibrator(raw, F.col("raw_score"), F.col("y"))
    scored = models.score_with_routes(df, fitted, calibrators)
    return scored.groupBy("route").agg(F.count("*").alias("n"), F.round(F.avg("threat_score"), 3).alias("mean_score"))


def l11_calibration_eligibility(spark, folder):
    sample = sampling.calibration_sample(_labelled(spark, folder), "chunk", "flow_id")
    by_port = models.can_calibrate(sample, F.col("y"), by=["dst_port"])
    return by_port


#: The depth-1 case that SQL repeats: penalties on gain (gamma), weights (L2) and gradients (L1), margin 0.
SPLIT_SETTINGS = boosting.BoostSettings(rounds=1, depth=1, eta=1.0, gamma=0.1, l2=1.0, l1=0.5, min_child_weight=1.0)
SPLIT_FEATURES = ["l_discount", "l_tax"]


def _returns(spark, folder):
    from flowtriage.plans.tables import table

    rows = table(spark, folder, "lineitem")
    return rows.select(*SPLIT_FEATURES, "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("returned"))


def _tree_rows(spark, ensemble, first=0):
    rows = ensemble.table(spark).where(F.col("tree") >= first)
    return rows.select("tree", "node", "feature", "threshold", F.round("weight", 8).alias("weight"))


def l02_histogram_split(spark, folder):
    """One second-order histogram split of every lineitem row: is a line returned, by discount and tax."""
    fitted = boosting.fit(_returns(spark, folder), SPLIT_FEATURES, "returned", SPLIT_SETTINGS, base_margin=0.0)
    return _tree_rows(spark, fitted)


def l05_histogram_predict(spark, folder):
    """Probabilities of the depth-1 model of l02_histogram_split for every line."""
    rows = _returns(spark, folder)
    fitted = boosting.fit(rows, SPLIT_FEATURES, "returned", SPLIT_SETTINGS, base_margin=0.0)
    return boosting.predict(rows, fitted).select("l_orderkey", "l_linenumber", F.round("probability", 8).alias("probability"))


def l09_histogram_importance(spark, folder):
    """Share of the split gains per feature in the depth-1 model of l02_histogram_split."""
    fitted = boosting.fit(_returns(spark, folder), SPLIT_FEATURES, "returned", SPLIT_SETTINGS, base_margin=0.0)
    shares = fitted.importance()
    return spark.createDataFrame([(f, float(shares[f])) for f in SPLIT_FEATURES], "feature string, importance double")


def l04_continued_boosting(spark, folder):
    """Trees fitted on the lines of even orders, stored, loaded and continued on the odd ones."""
    rows = _returns(spark, folder)
    settings = boosting.BoostSettings(rounds=3, depth=3, eta=0.3, gamma=0.05, l2=1.0, l1=0.1, row_sample=0.8)
    first = boosting.fit(rows.where(F.col("l_orderkey") % 2 == 0), SPLIT_FEATURES, "returned", settings)
    store = f"{checkpoint_root(spark).rstrip('/')}/ensembles/{hashlib.sha256(folder.encode()).hexdigest()[:12]}-{spark.sparkContext.applicationId}"
    first.table(spark).write.mode("overwrite").parquet(store)
    loaded = boosting.Ensemble.from_table(spark.read.parquet(store), SPLIT_FEATURES)
    continued = boosting.fit(rows.where(F.col("l_orderkey") % 2 == 1), SPLIT_FEATURES, "returned", settings, start=loaded)
    return _tree_rows(spark, continued, first=-1)


QUERIES = {f.__name__: f for f in (
    l02_histogram_split, l04_continued_boosting, l05_histogram_predict, l09_histogram_importance,
    l01_standardise, l02_train_detector, l03_class_weight, l04_refit_with_holdout, l05_predict,
    l06_isotonic_calibration, l07_calibrated_score, l09_feature_importance, t03_top_importance,
    l10_specialist_detectors, l11_calibration_eligibility, l02_training_counts, l04_holdout_counts,
    l05_prediction_counts, l09_importance_total, l10_route_counts,
)}

_HASH = "md5(concat(CAST(flow_id AS VARCHAR), ':42'))"

# Isotonic fit by the min-max formula over distinct scores: for each score the
# largest, over starts at or before it, of the smallest mean to any end after it.
_ISOTONIC = """
points AS (SELECT threat_score AS s, sum(y)::DOUBLE AS w, count(*)::DOUBLE AS c, row_number() OVER (ORDER BY threat_score) AS i
  FROM {source} GROUP BY threat_score),
cum AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(c) OVER (ORDER BY i) AS cc FROM points),
spans AS (SELECT a.i AS a, b.i AS b, (b.cw - a.cw + a.w) / (b.cc - a.cc + a.c) AS m FROM cum a JOIN cum b ON a.i <= b.i),
fits AS (SELECT p.i, p.s, max(lowest) AS calibrated FROM points p JOIN LATERAL (
  SELECT a, min(m) AS lowest FROM spans WHERE a <= p.i AND b >= p.i GROUP BY a) ON true GROUP BY p.i, p.s)
"""

_WEB_PORTS, _AUTH_PORTS = "(80,443,3000,5000,8000,8080,8443,8888)", "(21,22,23,1433,3306,3389,5432,5900,6379,27017)"

_SPLIT_SQL = """WITH r AS (
  SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS x0, CAST(l_tax AS DOUBLE) AS x1, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
gh AS (SELECT x0, x1, 0.5 - y AS g, 0.25 AS h FROM r),
tot AS (SELECT sum(g) AS G, sum(h) AS H FROM gh),
v AS (
  SELECT 0 AS fi, 'l_discount' AS feature, x0 AS t, sum(g) AS g, sum(h) AS h FROM gh GROUP BY x0
  UNION ALL SELECT 1, 'l_tax', x1, sum(g), sum(h) FROM gh GROUP BY x1),
c AS (SELECT fi, feature, t, sum(g) OVER w AS GL, sum(h) OVER w AS HL FROM v
      WINDOW w AS (PARTITION BY fi ORDER BY t NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT c.*, G - GL AS GR, H - HL AS HR, G, H FROM c, tot WHERE t IS NOT NULL AND HL >= 1 AND H - HL >= 1),
k AS (SELECT *, 0.5 * ((sign(GL) * greatest(abs(GL) - 0.5, 0)) ^ 2 / (HL + 1) + (sign(GR) * greatest(abs(GR) - 0.5, 0)) ^ 2 / (HR + 1) - (sign(G) * greatest(abs(G) - 0.5, 0)) ^ 2 / (H + 1)) - 0.1 AS gain FROM s),
best AS (SELECT * FROM k WHERE gain > 0 ORDER BY gain DESC, fi, t LIMIT 1)
"""
_PREDICT_SQL = """SELECT r.l_orderkey, r.l_linenumber, round(1 / (1 + exp(-(CASE
    WHEN b.feature IS NULL THEN (SELECT -(sign(G) * greatest(abs(G) - 0.5, 0)) / (H + 1) FROM tot)
    WHEN (b.feature = 'l_discount' AND (r.x0 IS NULL OR r.x0 <= b.t)) OR (b.feature = 'l_tax' AND (r.x1 IS NULL OR r.x1 <= b.t))
      THEN -(sign(b.GL) * greatest(abs(b.GL) - 0.5, 0)) / (b.HL + 1) ELSE -(sign(b.GR) * greatest(abs(b.GR) - 0.5, 0)) / (b.HR + 1) END))), 8) AS probability
FROM r LEFT JOIN best b ON TRUE"""

ORACLES = {
    "l02_histogram_split": _SPLIT_SQL + """SELECT 0 AS tree, 0 AS node, feature, t AS threshold, CAST(NULL AS DOUBLE) AS weight FROM best
UNION ALL SELECT 0, 1, NULL, NULL, round(-(sign(GL) * greatest(abs(GL) - 0.5, 0)) / (HL + 1), 8) FROM best
UNION ALL SELECT 0, 2, NULL, NULL, round(-(sign(GR) * greatest(abs(GR) - 0.5, 0)) / (HR + 1), 8) FROM best
UNION ALL SELECT 0, 0, NULL, NULL, round(-(sign(G) * greatest(abs(G) - 0.5, 0)) / (H + 1), 8) FROM tot WHERE NOT EXISTS (SELECT 1 FROM best)""",
    "l05_histogram_predict": _SPLIT_SQL + _PREDICT_SQL,
    "l09_histogram_importance": _SPLIT_SQL + """SELECT f.feature, CASE WHEN b.feature = f.feature THEN 1.0 ELSE 0.0 END AS importance
FROM (VALUES ('l_discount'), ('l_tax')) f(feature) LEFT JOIN best b ON TRUE""",
    "l02_training_counts": ITEMS_SQL + "SELECT y, count(*) AS n, count(*) AS in_range, count(*) AS consistent FROM items GROUP BY 1",
    "l04_holdout_counts": FLOWS_SQL + f""",
split AS (SELECT row_number() OVER (ORDER BY {_HASH}) <= greatest(1, CAST(floor(count(*) OVER () * 0.1e0) AS BIGINT)) AS is_eval FROM flows)
SELECT is_eval, count(*) AS n, true AS in_range FROM split GROUP BY 1""",
    "l05_prediction_counts": FLOWS_SQL + "SELECT dst_port, count(*) AS n, count(*) AS in_range, count(*) AS consistent FROM flows GROUP BY 1",
    "l09_importance_total": "SELECT 1e0 AS total, true AS none_negative",
    "l10_route_counts": FLOWS_SQL + f"""
SELECT CASE WHEN dst_port IN {_AUTH_PORTS} THEN 'auth' WHEN dst_port IN {_WEB_PORTS} THEN 'web' ELSE 'main' END AS route,
  count(*) AS n, true AS in_range FROM flows GROUP BY 1""",
    "l01_standardise": ITEMS_SQL + "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in ITEM_FEATURES
    ) + " FROM items",
    "l03_class_weight": ITEMS_SQL + """
SELECT month, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives,
  round(CASE WHEN count(*) FILTER (WHERE y = 1) > 0
    THEN CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) / count(*) FILTER (WHERE y = 1) ELSE 1e0 END, 5) AS positive_weight
FROM items GROUP BY 1""",
    "l06_isotonic_calibration": DECISIONS_SQL + "," + _ISOTONIC.format(source="decisions") + "SELECT s AS threat_score, round(calibrated, 5) AS calibrated FROM fits",
    # Scores between two fitted points are interpolated, outside ones clipped.
    "l07_calibrated_score": DECISIONS_SQL + f"""
, sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY {_HASH}) AS rn, count(*) OVER (PARTITION BY chunk) AS c FROM decisions)
  WHERE rn <= least(c // 20, 10000)),""" + _ISOTONIC.format(source="sample") + """
, near AS (SELECT d.s, max(f.s) FILTER (WHERE f.s <= d.s) AS lo, min(f.s) FILTER (WHERE f.s >= d.s) AS hi
  FROM (SELECT DISTINCT threat_score AS s FROM decisions) d, fits f GROUP BY d.s),
calibrated AS (SELECT near.s, CASE WHEN lo IS NULL THEN b.calibrated WHEN hi IS NULL OR hi = lo THEN a.calibrated
    ELSE a.calibrated + (b.calibrated - a.calibrated) * (near.s - lo) / (hi - lo) END AS score
  FROM near LEFT JOIN fits a ON a.s = lo LEFT JOIN fits b ON b.s = hi)
SELECT count(*) AS n, round(avg(y), 5) AS label_rate, round(avg(score), 4) AS mean_score
FROM decisions JOIN calibrated ON s = threat_score""",
    "l11_calibration_eligibility": DECISIONS_SQL + f"""
, cal AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY {_HASH}) AS rn, count(*) OVER (PARTITION BY chunk) AS c FROM decisions)
  WHERE rn <= least(c // 20, 10000))
SELECT dst_port, count(*) AS n, count(*) >= 10 AND min(y) = 0 AND max(y) = 1 AS eligible FROM cal GROUP BY 1""",
}
