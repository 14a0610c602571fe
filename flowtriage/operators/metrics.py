"""Confusion, family, reward and distribution reports.

All of these are single aggregations with map-side partials; result sizes are
set by the number of labels, actions, phases or 4-digit scores, not by rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.sources.workspace import durable


def label_counts(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(F.lower(F.trim(label)).alias("label")).agg(F.count("*").alias("n"))


def class_distribution(df: DataFrame, family: Column, truth: Column) -> DataFrame:
    """Rows and share per attack family, with the benign/attack totals beside."""
    counts = df.groupBy(family.alias("family"), truth.alias("is_attack")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))
    return counts.withColumn("class_n", F.sum("n").over(Window.partitionBy("is_attack"))).withColumn(
        "share", F.col("n") / F.sum("n").over(everything)
    )


MEDIAN_ACCURACY = 10_000
MEDIAN_MARGIN = 0.001  # ten times the rank error the sketch promises


def label_medians(df: DataFrame, label: Column, features: Iterable[str], top: int = 10, minimum: int = 5) -> DataFrame:
    """Exact median vector of benign traffic and of the most frequent attack labels.

    A quantile sketch brackets every median; a second pass counts the values
    below each bracket and collects only the distinct values inside it. Rows
    are never shuffled or unpivoted as a whole. A bracket that misses its
    median raises instead of returning an approximation.
    """
    names = list(features)
    key = F.trim(label)
    keyed = df.select(
        F.when(F.lower(key) == "benign", "benign").otherwise(key).alias("label"),
        *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(names)],
    )
    # Read several times below, so the label and its numbers are stored once, without all else.
    keyed = durable(keyed, "medians")
    counts = keyed.groupBy("label").agg(F.count("*").alias("n"))
    attacks = (
        counts.filter(F.col("label") != "benign").orderBy(F.desc("n"), "label").limit(top).filter(F.col("n") >= minimum)
    )
    chosen = attacks.unionByName(counts.filter(F.col("label") == "benign"))
    # ``chosen`` holds at most top + 1 rows, so it and the brackets broadcast.
    rows = keyed.join(F.broadcast(chosen.select("label")), "label", "left_semi")
    sides = F.array(F.lit(0.5 - MEDIAN_MARGIN), F.lit(0.5 + MEDIAN_MARGIN))
    brackets = rows.groupBy("label").agg(
        *[F.percentile_approx(f"f{i}", sides, MEDIAN_ACCURACY).alias(f"b{i}") for i in range(len(names))]
    )
    bracketed = rows.join(F.broadcast(brackets), "label")
    below = bracketed.groupBy("label").agg(
        *[F.count(f"f{i}").alias(f"n{i}") for i in range(len(names))],
        *[F.count_if(F.col(f"f{i}") < F.col(f"b{i}")[0]).alias(f"u{i}") for i in range(len(names))],
    ).select(
        "label",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("at"), F.col(f"n{i}").alias("total"), F.col(f"u{i}").alias("below"))
            for i in range(len(names))
        ])),
    )
    cells = F.array(*[
        F.when(
            F.col(f"f{i}").between(F.col(f"b{i}")[0], F.col(f"b{i}")[1]),
            F.struct(F.lit(i).alias("at"), F.col(f"f{i}").alias("value")),
        )
        for i in range(len(names))
    ])
    inside = (
        bracketed.select("label", F.inline(F.array_compact(cells)))
        .groupBy("label", "at", "value")
        .agg(F.count("*").alias("w"))
    )
    ordered = Window.partitionBy("label", "at").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        inside.join(F.broadcast(below), ["label", "at"])
        .withColumn("_to", F.col("below") + F.sum("w").over(ordered))
        .withColumn("_from", F.col("_to") - F.col("w"))
    )

    def value_at(position: Column) -> Column:
        return F.max(F.when((position > F.col("_from")) & (position <= F.col("_to")), F.col("value")))

    low = value_at(F.floor((F.col("total") + 1) / 2))
    high = value_at(F.floor((F.col("total") + 2) / 2))
    middle = (low + high) / 2
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1)
    return (
        placed.groupBy("label", "at")
        .agg(middle.alias("_m"))
        .join(F.broadcast(chosen), "label")
        .select(
            "label", feature.alias("feature"), "n",
            F.when(F.col("_m").isNull(), F.raise_error(F.lit("median outside its bracket")).cast("double"))
            .otherwise(F.col("_m")).alias("median"),
        )
    )


def class_statistics(df: DataFrame, features: Iterable[str], truth: Column) -> DataFrame:
    """Mean and sample deviation per feature and class, one row per feature."""
    names = list(features)
    y = truth
    columns = []
    for i, name in enumerate(names):
        value = F.col(name).cast("double")
        benign, attack = F.when(y == 0, value), F.when(y == 1, value)
        columns += [
            F.avg(benign).alias(f"bm{i}"), F.stddev_samp(benign).alias(f"bs{i}"),
            F.avg(attack).alias(f"am{i}"), F.stddev_samp(attack).alias(f"as{i}"),
        ]
    wide = df.agg(*columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("feature"),
                F.bround(f"bm{i}", 2).alias("benign_mean"), F.bround(f"bs{i}", 2).alias("benign_std"),
                F.bround(f"am{i}", 2).alias("attack_mean"), F.bround(f"as{i}", 2).alias("attack_std"),
            )
            for i, name in enumerate(names)
        ]
    )
    return wide.select(F.inline(rows))


def scaler_statistics(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Mean and population deviation per feature, one row per feature."""
    names = list(features)
    wide = df.agg(
        *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)],
        *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.inline(rows))


def confusion(df: DataFrame, truth: Column, positive: Column, false_alarm: Column | None = None, by: list | None = None) -> DataFrame:
    """TP / FP / FN / TN counts; rows without ground truth are left out.

    ``false_alarm`` marks benign rows counted as false positives when that is
    not the same as ``positive``.
    """
    alarm = positive if false_alarm is None else false_alarm
    return df.groupBy(*(by or [])).agg(
        F.count_if((truth == 1) & positive).alias("tp"),
        F.count_if((truth == 0) & alarm).alias("fp"),
        F.count_if((truth == 1) & ~positive).alias("fn"),
        F.count_if((truth == 0) & ~alarm).alias("tn"),
    )


def with_reported_rates(counts: DataFrame) -> DataFrame:
    rates = triage.reported_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[e.alias(n) for n, e in rates.items()])


def family_report(df: DataFrame, label: Column, score: Column, truth: Column, positive: Column) -> DataFrame:
    """Count, mean reported score, confusion and rates per label."""
    report = (
        df.filter(truth.isNotNull())
        .groupBy(F.trim(label).alias("label"))
        .agg(
            F.count("*").alias("n"),
            F.bround(F.avg(F.bround(score, 4)), 4).alias("avg_score"),
            F.count_if((truth == 1) & positive).alias("tp"),
            F.count_if((truth == 0) & positive).alias("fp"),
            F.count_if((truth == 1) & ~positive).alias("fn"),
            F.count_if((truth == 0) & ~positive).alias("tn"),
        )
    )
    return with_reported_rates(report)


def action_level_counts(df: DataFrame, action: Column, score: Column) -> DataFrame:
    return df.groupBy(
        triage.action_name(action).alias("action"), triage.threat_level(score).alias("level")
    ).agg(F.count("*").alias("n"))


def actions_by_load(df: DataFrame, load: str, action: Column) -> DataFrame:
    """Counts and percent of each action per load phase."""
    counted = df.groupBy(load).agg(
        *[F.count_if(action == i).alias(name.lower()) for i, name in enumerate(S.ACTIONS)]
    )
    return with_percent(counted)


def actions_by_load_from_policy(policy: DataFrame) -> DataFrame:
    """The same from policy visit counts, at the load bucket of each phase."""
    loads = [(load, min(int(load * S.LOAD_BUCKETS), S.LOAD_BUCKETS - 1)) for load in S.LOAD_PHASES]
    load = F.lit(None).cast("double")
    for value, at in loads:
        load = F.when(F.col("lb") == at, F.lit(value)).otherwise(load)
    counted = (
        policy.withColumn("analyst_load", load)
        .filter(F.col("analyst_load").isNotNull())
        .groupBy("analyst_load")
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col("action") == i, F.col("visits"))), F.lit(0)).alias(name.lower())
                for i, name in enumerate(S.ACTIONS)
            ]
        )
    )
    return with_percent(counted)


def with_percent(counted: DataFrame) -> DataFrame:
    names = [a.lower() for a in S.ACTIONS]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    whole = F.greatest(total, F.lit(1))
    return counted.select("*", *[(F.col(n) * 100.0 / whole).alias(f"{n}_pct") for n in names])


def label_action_matrix(df: DataFrame, truth: str, action: Column) -> DataFrame:
    return df.groupBy(truth).agg(
        *[F.count_if(action == i).alias(name.lower()) for i, name in enumerate(S.ACTIONS)]
    )


def score_histogram(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Benign and attack counts per distinct 4-digit score."""
    return df.groupBy(F.bround(score, 4).alias("score")).agg(
        F.count_if(truth == 0).alias("benign"), F.count_if(truth == 1).alias("attack")
    )


QUANTILE_BINS = 1_024


def exact_quantiles(df: DataFrame, key: str, value: str, shares: Iterable[float]) -> DataFrame:
    """key, at (index of the share) and the exact, linearly interpolated quantile of the values.

    Three scans, no sort of rows: a sketch brackets each quantile, equal-width
    bins of the bracket are counted, and only the bin that holds the wanted
    ranks is looked at value by value (about a millionth of a group). A bracket
    that misses its quantile raises. Null values do not count; keys may be null.
    """
    wanted = list(shares)
    rows = df.select(F.col(key).alias("_g"), F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    sides = [F.percentile_approx("_v", F.array(
        F.lit(max(0.0, p - MEDIAN_MARGIN)), F.lit(min(1.0, p + MEDIAN_MARGIN))), MEDIAN_ACCURACY) for p in wanted]
    rank = [1 + (F.col("_n") - 1) * F.lit(p) for p in wanted]
    # The margin is less than a rank in a small group; its bracket is all of it.
    small = F.col("_n") < 4 / MEDIAN_MARGIN
    low_side = lambda i: F.when(small, F.col("_min")).otherwise(F.col(f"_s{i}")[0])
    high_side = lambda i: F.when(small, F.col("_max")).otherwise(F.col(f"_s{i}")[1])
    sketched = rows.groupBy("_g").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        *[s.alias(f"_s{i}") for i, s in enumerate(sides)],
    )
    brackets = sketched.select(
        F.col("_g").alias("_k"),
        F.array(*[
            F.struct(F.lit(i).alias("at"), low_side(i).alias("lo"), high_side(i).alias("hi"), rank[i].alias("rank"))
            for i in range(len(wanted))
        ]).alias("_cells"),
    )

    def place(cell: Column) -> Column:
        """Bin of the value in a bracket; -1 below it."""
        width = F.nullif(cell["hi"] - cell["lo"], F.lit(0.0))
        inside = F.coalesce(F.floor((F.col("_v") - cell["lo"]) / width * QUANTILE_BINS).cast("int"), F.lit(0))
        return F.when(F.col("_v") < cell["lo"], -1).otherwise(F.least(inside, F.lit(QUANTILE_BINS - 1)))

    # A row per key and share; keys are actions, labels and the like.
    near = rows.join(F.broadcast(brackets), F.col("_g").eqNullSafe(F.col("_k"))).select("_g", "_v", F.explode("_cells").alias("c"))
    near = near.filter(F.col("_v") <= F.col("c.hi")).select("_g", "_v", "c.at", "c.rank", place(F.col("c")).alias("bin"))
    counts = near.groupBy("_g", "at", "rank", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("_g", "at").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("_to", F.sum("n").over(upto)).withColumn("_from", F.col("_to") - F.col("n"))
    low, high = F.floor("rank"), F.ceil("rank")
    holding = summed.filter((F.col("bin") >= 0) & (low <= F.col("_to")) & (high > F.col("_from"))).select(
        F.col("_g").alias("_k"), F.col("at").alias("_at"), F.col("bin").alias("_bin"), "_from"
    )
    # At most two bins per key and share.
    same = F.col("_g").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")) & (F.col("bin") == F.col("_bin"))
    values = near.join(F.broadcast(holding), same).groupBy("_g", "at", "rank", "bin", "_from", "_v").agg(F.count("*").alias("w"))
    within = Window.partitionBy("_g", "at", "bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_to", F.col("_from") + F.sum("w").over(within)).withColumn("_first", F.col("_to") - F.col("w"))

    def value_at(wanted_rank: Column) -> Column:
        return F.max(F.when((wanted_rank > F.col("_first")) & (wanted_rank <= F.col("_to")), F.col("_v")))

    picked = ranked.groupBy("_g", "at").agg(
        value_at(low).alias("lower"), value_at(high).alias("upper"), F.first(F.col("rank") - low).alias("share")
    )
    between = F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("share")
    missed = F.raise_error(F.lit("quantile outside its bracket")).cast("double")
    return picked.select(F.col("_g").alias(key), "at", F.when(between.isNull(), missed).otherwise(between).alias("quantile"))


def reward_distribution(df: DataFrame, action: Column, reward: Column) -> DataFrame:
    """Five-number summary of the rewards as they are, per action, with whiskers."""
    rows = df.select(triage.action_name(action).alias("action"), reward.cast("double").alias("r"))
    quartiles = exact_quantiles(rows, "action", "r", (0.25, 0.5, 0.75)).groupBy(F.col("action").alias("_q")).agg(
        *[F.max(F.when(F.col("at") == i, F.col("quantile"))).alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    )
    # A row per action.
    same = F.col("action").eqNullSafe(F.col("_q"))
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    near = F.when(F.col("r").between(F.col("q1") - spread, F.col("q3") + spread), F.col("r"))
    return (
        rows.join(F.broadcast(quartiles), same)
        .groupBy("action", "q1", "median", "q3")
        .agg(
            F.count("r").alias("n"), F.min("r").alias("low"), F.max("r").alias("high"),
            F.min(near).alias("whisker_low"), F.max(near).alias("whisker_high"),
        )
        .select("action", "n", "low", "q1", "median", "q3", "high", "whisker_low", "whisker_high")
    )


def outcome_share(df: DataFrame, truth: Column, action: Column) -> DataFrame:
    """Percent of decisions per action and truth, truncated to whole percents."""
    kind = F.when(truth == 1, "Threat").otherwise("Benign")
    name = F.concat(triage.action_name(action), F.lit(" ("), kind, F.lit(")"))
    counts = df.groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # at most six rows
    return counts.withColumn("pct", F.floor(F.col("n") / total * 100).cast("int")).orderBy(F.desc("n"), "outcome")


def kpi_counters(df: DataFrame, truth: Column, action: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("events_captured"),
        F.count_if(truth == 1).alias("active_threats"),
        F.count_if((truth == 1) & (action == 0)).alias("failed_requests"),
        F.count_if(action >= 1).alias("flagged_ips"),
    )


def policy_heatmap(policy: DataFrame) -> DataFrame:
    """Best mean action value and visits per threat and load bucket.

    Means run over the dense density x port grid: cells absent from the table
    count as 0. Equal means resolve to the smaller action.
    """
    cells = S.DENSITY_BUCKETS * S.PORT_CLASS_COUNT
    means = policy.groupBy("tb", "lb").agg(
        *[(F.coalesce(F.sum(F.when(F.col("action") == a, F.col("q"))), F.lit(0.0)) / cells).alias(f"q{a}") for a in range(3)],
        F.sum("visits").alias("visits"),
    )
    best = F.array_max(F.array(*[F.struct(F.col(f"q{a}").alias("v"), F.lit(-a).alias("neg")) for a in range(3)]))
    return means.select("tb", "lb", "visits", (-best["neg"]).alias("best_action"), best["v"].alias("best_q"))


def chunk_quality(df: DataFrame, chunk: str, predicted: Column, truth: Column) -> DataFrame:
    return df.groupBy(chunk).agg(
        F.count("*").alias("n"),
        F.avg((predicted == truth).cast("double")).alias("accuracy"),
        F.avg(truth).alias("threat_rate"),
    )


def heldout_accuracy(df: DataFrame, chunk: str, predicted: Column, truth: Column, chunks: int = 2) -> DataFrame:
    """Accuracy over the last ``chunks`` chunks."""
    newest = df.select(chunk).distinct().orderBy(F.desc(chunk)).limit(chunks)
    held = df.join(F.broadcast(newest), chunk, "left_semi")
    right = F.count_if(predicted == truth)
    return held.agg(
        F.count("*").alias("n"), right.alias("correct"), (right / F.greatest(F.lit(1), F.count("*"))).alias("accuracy")
    )


def calibration_summary(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg(truth).alias("label_rate"), F.avg(score).alias("mean_score"))


def summary_card(df: DataFrame, truth: Column, action: Column, reward: Column) -> DataFrame:
    """One row: precision, recall, F1, total reward, steps."""
    counts = df.agg(
        F.count_if((truth == 1) & (action >= 1)).alias("tp"),
        F.count_if((truth == 0) & (action == 2)).alias("fp"),
        F.count_if((truth == 1) & (action == 0)).alias("fn"),
        F.sum(reward).alias("total_reward"),
        F.count("*").alias("steps"),
    )
    precision = F.bround(triage.share(F.col("tp"), F.col("tp") + F.col("fp")), 4)
    recall = F.bround(triage.share(F.col("tp"), F.col("tp") + F.col("fn")), 4)
    return counts.select(
        precision.alias("precision"), recall.alias("recall"),
        triage.harmonic(precision, recall).alias("f1"), "total_reward", "steps",
    )


def dataset_inventory(df: DataFrame, group: Column, fmt: Column, file: Column) -> DataFrame:
    """Files and rows per dataset group and format."""
    per_file = df.groupBy(group.alias("dataset"), fmt.alias("format"), file.alias("file")).agg(F.count("*").alias("n"))
    return per_file.groupBy("dataset", "format").agg(F.count("*").alias("files"), F.sum("n").alias("total_rows"))
