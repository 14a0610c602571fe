"""Writers: result documents, versioned tables, models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage import schema as S
from flowtriage.operators.metrics import kpi_counters
from flowtriage.operators.policy import empty_policy, migrate_without_ports
from flowtriage.operators.sampling import representative_log
from flowtriage.sources.workspace import exists, subfolders


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scenario_documents(medians: DataFrame) -> DataFrame:
    """Label medians as one document per scenario (see ``metrics.label_medians``)."""
    name = F.replace(F.replace(F.lower("label"), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    return medians.groupBy(name.alias("scenario"), "label").agg(
        F.first("n").alias("sample_count"),
        F.map_from_entries(F.collect_list(F.struct("feature", "median"))).alias("features"),
    )


def run_state(log: DataFrame, sample_rows: int = 100) -> DataFrame:
    """KPI counters and a representative log excerpt as one nested row.

    ``log`` has step, threat_score, action (0..2), true_label, reward,
    analyst_load, dst_port and flow_dur.
    """
    from flowtriage.functions.triage import action_name

    excerpt = representative_log(log, sample_rows).withColumn("action", action_name(F.col("action")))
    fields = [f.name for f in S.DECISION_SCHEMA]
    # The excerpt has at most ``sample_rows`` rows.
    entries = excerpt.agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("logs")).scalar()
    return kpi_counters(log, F.col("true_label"), F.col("action")).withColumn("logs", entries)


# -- versioned tables --------------------------------------------------------

def save_version(df: DataFrame, folder: str, version: int) -> None:
    """Write one immutable version; repeating a version replaces only itself."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/version={version}")


def load_version(spark: SparkSession, folder: str, at_most: int | None = None) -> tuple[DataFrame | None, int]:
    """Newest version (not above ``at_most``) and its number; (None, -1) if there is none.

    Only the folder is listed. Faults other than a missing folder are raised,
    so a store that fails for a moment never looks empty.
    """
    root = folder.rstrip("/")
    numbers = [
        int(name.removeprefix("version="))
        for name in subfolders(spark, root)
        if name.startswith("version=") and name.removeprefix("version=").isdigit()
    ]
    numbers = sorted((n for n in numbers if at_most is None or n <= at_most), reverse=True)
    # A version counts once its job has committed.
    newest = next((n for n in numbers if exists(spark, f"{root}/version={n}/_SUCCESS")), None)
    if newest is None:
        return None, -1
    # Read that version's files alone, so other versions may have other columns.
    return spark.read.parquet(f"{root}/version={newest}"), newest


def save_policy(policy: DataFrame, folder: str, version: int | None = None) -> int:
    spark = policy.sparkSession
    if version is None:
        version = load_version(spark, folder)[1] + 1
    # At most 18,000 rows: one file.
    save_version(policy.select(*S.POLICY_SCHEMA.names).coalesce(1), folder, version)
    return version


def load_policy(spark: SparkSession, folder: str, at_most: int | None = None) -> tuple[DataFrame, bool]:
    """The stored policy and whether it was usable.

    A table without port classes is copied to each of them; any other layout
    starts fresh.
    """
    stored, _ = load_version(spark, folder, at_most)
    expected = set(S.POLICY_SCHEMA.names)
    if stored is None:
        return empty_policy(spark), False
    columns = set(stored.columns)
    if columns == expected - {"pb"}:
        stored = migrate_without_ports(stored)
    elif columns != expected:
        return empty_policy(spark), False
    typed = stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.POLICY_SCHEMA])
    return typed, True


# -- models ------------------------------------------------------------------

def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def _is_fitted(model) -> bool:
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    return hasattr(last, "featureImportances") or hasattr(last, "boundaries")


def load_or_fit(load: Callable[[], object], fit: Callable[[], object], path: str) -> tuple[object, bool]:
    """A stored model if there is a fitted one, else a new fit, which is stored.

    Only an absent model, or one stored before it was fitted, is replaced. A
    model that cannot be read raises and stays as it is.
    """
    spark = SparkSession.active()
    if exists(spark, path):
        model = load()
        if _is_fitted(model):
            return model, True
    model = fit()
    save_model(model, path)
    return model, False


def load_detector(path: str, fit: Callable[[], PipelineModel]) -> tuple[PipelineModel, bool]:
    model, loaded = load_or_fit(lambda: PipelineModel.load(path), fit, path)
    model.stored = path.rstrip("/")  # scoring reads the trees there
    return model, loaded


def load_calibrator(path: str, fit: Callable[[], IsotonicRegressionModel]) -> tuple[IsotonicRegressionModel, bool]:
    return load_or_fit(lambda: IsotonicRegressionModel.load(path), fit, path)


def save_scaler(spark: SparkSession, scaler: dict[str, tuple[float, float]], path: str) -> None:
    rows = [(name, mean, scale) for name, (mean, scale) in scaler.items()]
    spark.createDataFrame(rows, "feature string, mean double, scale double").coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str, fit: Callable[[], dict]) -> dict[str, tuple[float, float]]:
    """The stored scaler (one row per feature), or a new one if there is none."""
    rows = spark.read.parquet(path).select("feature", "mean", "scale").collect() if exists(spark, path) else []
    if rows:
        return {r["feature"]: (r["mean"], r["scale"]) for r in rows}
    scaler = fit()
    save_scaler(spark, scaler, path)
    return scaler
