"""From canonical flows to scores, actions and a report, as one lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from flowtriage import schema as S
from flowtriage.functions import flow, triage
from flowtriage.operators import behaviour, metrics, models, ordered, policy
from flowtriage.sources.workspace import durable

# Working names of the canonical columns that later steps read.
_NAMES = {
    "dst_port": "Dst Port", "flow_duration": "Flow Duration", "pkt_size_avg": "Pkt Size Avg",
    "totlen_fwd_pkts": "TotLen Fwd Pkts",
}


def score_table(
    flows: DataFrame,
    detectors: dict[str, PipelineModel],
    calibrators: dict[str, IsotonicRegressionModel],
    known: DataFrame,
    load: Column,
    step: str = "step",
    mode: str = "arrival",
    window_seconds: int = S.BEHAVIOUR_WINDOW_SECONDS,
    max_flows: int = S.BEHAVIOUR_MAX_FLOWS,
    block_rows: int = ordered.BLOCK_ROWS,
    keep: Sequence[str] = tuple(S.FEATURES),
) -> DataFrame:
    """Route, detector score, calibration, behaviour, fusion and policy action of every flow.

    ``flows`` comes from ``canonicalise`` with transport columns and has a
    unique ``step`` that orders the rows; an uploaded table arrives at one
    instant (``mode="arrival"``), a log with times uses ``mode="event_time"``
    and a ``ts`` column. Every row is scored once, by the detector of its
    route, and keeps its place: no row is lost for a missing source, label or
    port. ``known`` is the policy, frozen for this table. ``keep`` names the
    canonical features that stay beside the scores: all, unless the caller needs
    fewer. The scored rows are stored once, below ``spark.checkpoint.dir``; what
    follows reads them more than once.
    """
    named = flows.withColumns({n: F.col(f"`{c}`").cast("double") for n, c in _NAMES.items()})
    named = named.withColumn("dst_port", F.col("dst_port").cast("int"))
    if mode == "arrival":
        named = named.withColumn("ts", F.lit(None).cast("timestamp"))
    ports = [F.col(p) for p in ("dst_port", "src_port") if p in named.columns]
    routed = named.withColumn("route", models.route(ports))
    scored = models.score_with_routes(routed, detectors, calibrators)
    stored = durable(scored.drop(*[f for f in S.FEATURES if f not in keep]), "scored")
    seen = behaviour.behaviour_features(
        stored, window_seconds, max_flows, step=step, mode=mode, block_rows=block_rows
    ).withColumn("fused_score", triage.fused_score(F.col("threat_score"), F.col("behaviour_score")))
    placed = ordered.threat_density(seen, "fused_score", step=step, block_rows=block_rows, counted=stored)
    decided = policy.decide(placed, known, "fused_score", load, step=step)
    return decided.withColumns(
        {
            "y": flow.binary_label(F.col("Label")),
            "level": triage.threat_level(F.col("fused_score")),
            "detected": F.col("fused_score") > triage.detection_threshold(F.col("dst_port")),
        }
    )


def score_report(scored: DataFrame) -> DataFrame:
    """The per-family report of a scored table."""
    named = scored.withColumn("family", flow.family(F.col("Label")))
    return metrics.family_report(named, F.col("family"), F.col("threat_score"), F.col("y"), F.col("detected"))
