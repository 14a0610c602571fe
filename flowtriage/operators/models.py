"""Threat detectors on Spark ML: scale, weight, train, calibrate, route, fuse."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowtriage import schema as S
from flowtriage.functions.flow import on_service_port
from flowtriage.operators.cell_trees import CellGBTClassifier, margin_column, tree_stages
from flowtriage.operators.metrics import scaler_statistics
from flowtriage.sources.workspace import checkpoint_root


# -- scaling and weighting ---------------------------------------------------

def fit_scaler(df: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and scale per feature from one pass; zero spread scales by 1."""
    rows = scaler_statistics(df, features).collect()  # one row per feature
    return {r["feature"]: (r["mean"], r["std"] if r["std"] else 1.0) for r in rows}


def standardise(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """Replace each scaled feature by (x - mean) / scale as float."""
    return df.withColumns(
        {name: ((F.col(name) - mean) / scale).cast("float") for name, (mean, scale) in scaler.items()}
    )


def standardise_inline(df: DataFrame, features: list[str]) -> DataFrame:
    """The same without a driver round trip: statistics join as a scalar."""
    stats = df.agg(
        F.struct(*[F.struct(F.avg(f).alias("m"), F.stddev_pop(f).alias("s")).alias(f"f{i}") for i, f in enumerate(features)]).alias("s")
    ).scalar()
    with_stats = df.withColumn("_s", stats)
    scaled = {}
    for i, f in enumerate(features):
        cell = F.col("_s")[f"f{i}"]
        scaled[f] = (F.col(f) - cell["m"]) / F.when(cell["s"] == 0, 1.0).otherwise(cell["s"])
    return with_stats.withColumns(scaled).drop("_s")


def class_weights(df: DataFrame, truth: str, by: list[str] | None = None) -> DataFrame:
    """Counts and positive-class weight (negatives / positives); 1 without positives."""
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(F.col(truth) == 1).alias("positives"), F.count_if(F.col(truth) == 0).alias("negatives")
    )
    weight = F.when(F.col("positives") > 0, F.col("negatives") / F.greatest(F.col("positives"), F.lit(1))).otherwise(1.0)
    return counts.withColumn("positive_weight", weight)


def with_class_weight(df: DataFrame, truth: str, out: str = "weight") -> DataFrame:
    positives = F.count_if(F.col(truth) == 1)
    ratio = df.agg(
        F.when(positives > 0, F.count_if(F.col(truth) == 0) / F.greatest(positives, F.lit(1))).otherwise(1.0).alias("w")
    ).scalar()
    return df.withColumn(out, F.when(F.col(truth) == 1, ratio).otherwise(1.0))


# -- training and scoring ----------------------------------------------------

@dataclass(frozen=True)
class DetectorSettings:
    """Boosting parameters; the defaults are the fixed production values."""

    rounds: int = 250
    depth: int = 8
    step_size: float = 0.08
    row_share: float = 0.75
    feature_share: str = "0.75"
    min_rows_per_leaf: int = 7
    min_gain: float = 0.0
    seed: int = 42
    eval_column: str | None = None


#: Training rows of a task. A fit keeps about 250 bytes of each in memory, so a task reads some 60 MB a pass.
TASK_ROWS = 250_000
#: Fewer rows than this are not worth a task of their own.
LEAST_ROWS = 20_000


def in_even_tasks(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over tasks whose number follows the row count, however the input files are cut."""
    n = df.count()
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS))
    return df.repartition(max(1, tasks, math.ceil(n / TASK_ROWS)))


def train_detector(df: DataFrame, features: list[str], truth: str, settings: DetectorSettings = DetectorSettings()) -> PipelineModel:
    """Boosted trees over all rows at once, positives weighted by neg/pos.

    Row groups need no chunk-wise continuation here: the bins and cells of
    ``cell_trees`` come from the whole (spillable) input, at most ``TASK_ROWS``
    rows a task, and every tree reads all of them. ``eval_column`` names a
    boolean hold-out column for early stopping.
    """
    weighted = with_class_weight(df, truth)
    columns = [*features, truth, "weight"] + ([settings.eval_column] if settings.eval_column else [])
    prepared = in_even_tasks(weighted.select(*columns).withColumn(truth, F.col(truth).cast("double")))
    booster = GBTClassifier(
        labelCol=truth,
        featuresCol="features",
        weightCol="weight",
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.step_size,
        subsamplingRate=settings.row_share,
        featureSubsetStrategy=settings.feature_share,
        minInstancesPerNode=settings.min_rows_per_leaf,
        minInfoGain=settings.min_gain,
        seed=settings.seed,
        # One task aggregates one node's histograms; keep many nodes per pass.
        maxMemoryInMB=512,
        cacheNodeIds=False,
        checkpointInterval=10,
    )
    # The early stop of a hold-out is the booster's own.
    stage = booster.setValidationIndicatorCol(settings.eval_column) if settings.eval_column else CellGBTClassifier(booster)
    checkpoint_root(df.sparkSession)  # long fits cut their lineage there
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, stage]).fit(prepared)


def score_flows(df: DataFrame, model: PipelineModel, out: str = "raw_score") -> DataFrame:
    """Add P(threat) and the predicted class."""
    stages = tree_stages(model)
    if stages:
        stored = getattr(model, "stored", None)  # set by sinks.load_detector
        margin = df.withColumn("_margin", margin_column(*stages, stored and f"{stored}/stages/1_{stages[1].uid}"))
        return margin.withColumn(out, 1 - 1 / (1 + F.exp(2 * F.col("_margin")))).withColumn(
            "predicted", (F.col("_margin") > 0).cast("int")
        ).drop("_margin")
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).withColumn(
        "predicted", F.col("prediction").cast("int")
    ).drop("features", "rawPrediction", "probability", "prediction")


def feature_importance(spark: SparkSession, model: PipelineModel, features: list[str], top: int = 20) -> DataFrame:
    """Positive importances, largest first, with percent; at most ``top`` rows."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    values += [0.0] * (len(features) - len(values))
    pairs = [(f, float(v)) for f, v in zip(features, values) if v > 0.0]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(top).withColumn(
        "importance_pct", F.col("importance") * 100.0
    )


# -- calibration -------------------------------------------------------------

def calibration_points(df: DataFrame, score: Column, truth: Column) -> DataFrame:
    """Weighted label rate per distinct score: ties merge, rows reduce map-side."""
    return df.groupBy(score.cast("double").alias("score")).agg(
        F.avg(truth.cast("double")).alias("rate"), F.count("*").cast("double").alias("weight")
    )


def can_calibrate(df: DataFrame, truth: Column, by: list | None = None, minimum: int = 10) -> DataFrame:
    """Whether a group has enough rows and both classes for its own calibrator."""
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        ((F.count("*") >= minimum) & (F.count_if(truth == 1) > 0) & (F.count_if(truth == 0) > 0)).alias("eligible"),
    )


def fit_calibrator(df: DataFrame, score: Column, truth: Column) -> IsotonicRegressionModel:
    return IsotonicRegression(
        featuresCol="score", labelCol="rate", weightCol="weight", predictionCol="calibrated"
    ).fit(calibration_points(df, score, truth))


def calibrate(df: DataFrame, model: IsotonicRegressionModel | None, score: str = "raw_score", out: str = "calibrated") -> DataFrame:
    """Calibrated score; the raw one where no calibrator exists."""
    if model is None:
        return df.withColumn(out, F.col(score))
    renamed = model.setFeaturesCol(score).setPredictionCol("_calibrated").transform(df.withColumn(score, F.col(score).cast("double")))
    return renamed.withColumn(out, F.coalesce("_calibrated", score)).drop("_calibrated")


# -- routing -----------------------------------------------------------------

def route(
    ports: list[Column],
    source_file: Column | None = None,
    packet_rate: Column | None = None,
) -> Column:
    """Which detector scores a flow: auth before web before flood before main.

    ``ports`` is [dst] when training and simulating, [dst, src] when scoring
    tables. The flood route exists on streams only, where the capture file and
    the packet rate are known.
    """
    chosen = F.when(on_service_port(S.AUTH_PORTS, *ports), "auth").when(
        on_service_port(S.WEB_PORTS, *ports), "web"
    )
    if source_file is not None and packet_rate is not None:
        flood = F.lower(source_file).isin(*S.FLOOD_STREAM_FILES) & (
            F.coalesce(packet_rate, F.lit(0.0)) > S.FLOOD_MIN_PACKET_RATE
        )
        chosen = chosen.when(flood, "flood")
    return chosen.otherwise("main")


def routed_score(route_column: Column, scores: dict[str, Column]) -> Column:
    """The score of the flow's own detector; missing detectors fall back to main."""
    picked = F.lit(None).cast("double")
    for name, score in scores.items():
        if name != "main":
            picked = F.when(route_column == name, score).otherwise(picked)
    return F.coalesce(picked, scores["main"])


def route_training_rows(df: DataFrame, name: str, port: str, file: str | None = None) -> DataFrame:
    """Training rows of a specialist: by port for web and auth, by file for flood."""
    if name == "web":
        return df.filter(F.col(port).isin(*S.WEB_PORTS))
    if name == "auth":
        return df.filter(F.col(port).isin(*S.AUTH_PORTS))
    if name == "flood" and file:
        return df.filter(F.lower(F.col(file)).isin(*S.FLOOD_TRAINING_FILES))
    return df


def score_with_routes(
    df: DataFrame,
    models: dict[str, PipelineModel],
    calibrators: dict[str, IsotonicRegressionModel],
    route_column: str = "route",
    raw_routes: tuple[str, ...] = ("flood",),
) -> DataFrame:
    """Score every row once, with the detector of its route.

    The table is filtered per route (routes without a model use main's) and
    the parts are united; there is no join back. ``raw_routes`` stay
    uncalibrated; a specialist without a calibrator uses main's.
    """
    known = [name for name in models if name != "main"]
    united = None
    for name, model in models.items():
        mine = F.col(route_column) == name if name != "main" else ~F.col(route_column).isin(*known)
        part = score_flows(df.filter(mine), model)
        calibrator = None if name in raw_routes else calibrators.get(name, calibrators.get("main"))
        part = calibrate(part, calibrator, "raw_score", "threat_score")
        united = part if united is None else united.unionByName(part)
    return united

