"""Expressions for scores, decisions, rewards and quality rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowtriage import schema as S
from flowtriage.functions.flow import port_class


def threat_level(score: Column) -> Column:
    return F.when(score > 0.7, "HIGH").when(score > 0.3, "MEDIUM").otherwise("LOW")


def detection_threshold(dst_port: Column) -> Column:
    """Web services alarm earlier than everything else."""
    return F.when(dst_port.isin(*S.WEB_PORTS), 0.35).otherwise(0.5)


def threshold_action(score: Column, specialist: Column) -> Column:
    """Deterministic triage used on streams; specialist-routed flows monitor earlier."""
    monitor_from = F.when(specialist, 0.30).otherwise(0.35)
    return F.when(score >= 0.75, 2).when(score >= monitor_from, 1).otherwise(0)


def action_name(action: Column) -> Column:
    return F.element_at(F.array(*[F.lit(a) for a in S.ACTIONS]), action + 1)


def fused_score(*scores: Column) -> Column:
    return F.greatest(*scores)


def outcome(truth: Column, positive: Column, missing: str | None = "?") -> Column:
    """TP / FP / FN / TN, or ``missing`` for rows without ground truth."""
    return (
        F.when(truth.isNull(), F.lit(missing))
        .when((truth == 1) & positive, "TP")
        .when((truth == 0) & positive, "FP")
        .when(truth == 1, "FN")
        .otherwise("TN")
    )


def feed_tag(truth: Column, action: Column) -> Column:
    """Display tag of a decision in the traffic feed."""
    return (
        F.when(action == 2, "BLOCKED - IP ON BLOCK LIST")
        .when((truth == 1) & (action == 0), "FAIL")
        .when(action == 1, "DENIED - RESTRICTED ENDPOINT")
        .otherwise("ALLOWED")
    )


def bucket(value: Column, buckets: int) -> Column:
    """Index of ``value`` in [0, 1] among equal-width buckets, clipped at both ends."""
    scaled = F.least(F.greatest(value * buckets, F.lit(0.0)), F.lit(buckets - 1.0))
    return F.floor(scaled).cast("int")


def state_columns(score: Column, load: Column, density: Column, dst_port: Column) -> dict[str, Column]:
    """The four coordinates of a triage state."""
    return {
        "tb": bucket(score, S.THREAT_BUCKETS),
        "lb": bucket(load, S.LOAD_BUCKETS),
        "db": bucket(density, S.DENSITY_BUCKETS),
        "pb": port_class(dst_port),
    }


def reward(truth: Column, action: Column, load: Column, score: Column) -> Column:
    """Asymmetric payoff of an action once the truth is known."""
    threat = truth == 1
    return (
        F.when(threat & (action == 0), S.REWARD_MISSED_THREAT * (1 + score))
        .when(threat & (action == 2), S.REWARD_ESCALATED_THREAT * (1 + score))
        .when(threat & (action == 1), S.REWARD_MONITORED_THREAT * (1 - load))
        .when(action == 0, F.lit(S.REWARD_DISMISSED_BENIGN))
        .when(action == 2, S.REWARD_ESCALATED_BENIGN * (1 + load))
        .otherwise(F.lit(S.REWARD_MONITORED_BENIGN))
    )


def exploration(state_visits: Column) -> Column:
    """Exploration indicator: 1 in a cold state, then decaying towards 0.01."""
    return F.when(state_visits == 0, 1.0).otherwise(
        F.greatest(F.lit(0.01), 1 / (1 + 0.001 * state_visits))
    )


def learning_rate(visits: Column) -> Column:
    """Step size of an update, ``visits`` counted after the update."""
    return S.LEARNING_RATE / (1 + S.LEARNING_DECAY * visits)


def share(part: Column, whole: Column) -> Column:
    """part / max(1, whole)."""
    return part / F.greatest(whole, F.lit(1))


def harmonic(precision: Column, recall: Column) -> Column:
    """F1 with a tiny floor on the denominator."""
    return 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))


def reported_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Rates as the score report prints them: 4 digits, half-even.

    ``f1_compat`` keeps the report's floor of 1 on P + R, which understates F1
    whenever P + R < 1; ``f1`` is the ordinary one.
    """
    precision = F.bround(share(tp, tp + fp), 4)
    recall = F.bround(share(tp, tp + fn), 4)
    return {
        "precision": precision,
        "recall": recall,
        "f1_compat": F.bround(2 * precision * recall / F.greatest(precision + recall, F.lit(1.0)), 4),
        "f1": F.bround(harmonic(precision, recall), 4),
        "fpr": F.bround(share(fp, fp + tn), 4),
    }


def running_rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Unrounded rates, as tracked along a run."""
    precision, recall = share(tp, tp + fp), share(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": harmonic(precision, recall),
        "fpr": share(fp, fp + tn),
    }


def quality_band(value: Column, good: float, fair: float, lower_is_better: bool = False) -> Column:
    if lower_is_better:
        return F.when(value <= good, "green").when(value <= fair, "yellow").otherwise("red")
    return F.when(value >= good, "green").when(value >= fair, "yellow").otherwise("red")


# Fixed values: (good, fair, lower_is_better) per reported rate.
BANDS = {
    "recall": (0.95, 0.8, False),
    "precision": (0.8, 0.6, False),
    "f1": (0.85, 0.7, False),
    "fpr": (0.2, 0.5, True),
}
