"""Readers: flow captures in any dialect, SOC events, uploads, saved state."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowtriage import schema as S
from flowtriage.operators.clean import canonicalise, feature_coverage

FORMATS = ("parquet", "csv")


def list_files(spark: SparkSession, folder: str, allow: Iterable[str] | None = None) -> list[str]:
    """Paths of all capture files of a folder, sorted by path.

    ``allow`` restricts the list to given file names (any case). Only the file
    listing is read; the result is as long as the number of files.
    """
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{parquet,csv}").load(folder).select("path")
    )
    if allow is not None:
        wanted = [name.lower() for name in allow]
        listing = listing.filter(F.lower(F.element_at(F.split("path", "/"), -1)).isin(*wanted))
    return sorted(row["path"] for row in listing.collect())


def _file_format(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def _header(spark: SparkSession, path: str) -> tuple:
    """(format, column names, column types) of one file, from its footer or first line."""
    if _file_format(path) == "parquet":
        found = spark.read.parquet(path).schema
        return "parquet", tuple(found.names), found.json()
    first = spark.read.csv(path, header=False).limit(1).collect()
    names = tuple("" if v is None else v for v in first[0]) if first else ()
    return "csv", names, ""


def group_by_header(spark: SparkSession, files: list[str], uniform: Iterable[str] = ()) -> list[tuple[tuple, list[str]]]:
    """Files grouped by identical header, so each group is one scan.

    Headers are looked up on driver threads. Files matching a pattern in
    ``uniform`` are declared to share one header; only one of them is opened
    here, and the scan fails on a CSV file whose header differs. A header with
    repeated names cannot be checked by the scan, so such files are all opened.
    """
    patterns = list(uniform)
    sets: dict[str, list[str]] = {}
    for path in files:
        name = path.rsplit("/", 1)[-1]
        pattern = next((p for p in patterns if fnmatch(name, p)), None)
        sets.setdefault(f"{pattern}|{_file_format(path)}" if pattern else path, []).append(path)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda members: _header(spark, members[0]), sets.values()))
    groups: dict[tuple, list[str]] = {}
    for header, members in zip(headers, sets.values()):
        if header[0] == "csv" and len(members) > 1 and not _unique(header[1]):
            for path in members:
                groups.setdefault(_header(spark, path), []).append(path)
        else:
            groups.setdefault(header, []).extend(members)
    return list(groups.items())


def _unique(names: tuple[str, ...]) -> bool:
    return all(names) and len({n.lower() for n in names}) == len(names)


def _scan(spark: SparkSession, header: tuple, paths: list[str]) -> DataFrame:
    """One scan of files sharing a header, with ``_file`` last."""
    kind, names, _ = header
    if kind == "parquet":
        raw = spark.read.schema(spark.read.parquet(paths[0]).schema).parquet(*paths)
    else:
        # With the names known, Spark compares them with each file's own header.
        checked = _unique(names)
        text = T.StructType([T.StructField(n if checked else f"_c{i}", T.StringType()) for i, n in enumerate(names)])
        raw = spark.read.csv(paths, header=True, schema=text, mode="PERMISSIVE", enforceSchema=not checked)
    return raw.select("*", F.col("_metadata.file_name").alias("_file")).toDF(*names, "_file")


def read_flows(
    spark: SparkSession,
    folder: str | None = None,
    files: list[str] | None = None,
    allow: Iterable[str] | None = None,
    on_bad: str = "drop",
    fallbacks: bool = False,
    uniform: Iterable[str] = (),
) -> DataFrame:
    """All captures as one canonical table with source file and transport columns.

    Parquet and CSV files of any dialect mix freely. ``coverage`` is the number
    of canonical features the row's file supplies.
    """
    paths = files if files is not None else list_files(spark, folder, allow)
    if files is not None and allow is not None:
        wanted = {name.lower() for name in allow}
        paths = [p for p in paths if p.rsplit("/", 1)[-1].lower() in wanted]
    if not paths:
        raise FileNotFoundError("no .parquet or .csv capture files found")
    united = None
    for header, members in group_by_header(spark, paths, uniform):
        if not header[1]:
            continue
        raw = _scan(spark, header, members)
        part = canonicalise(
            raw, on_bad=on_bad, fallbacks=fallbacks, keep={"source_file": F.col("_file")}, transport=True
        ).withColumn("coverage", F.lit(feature_coverage(header[1], fallbacks)))
        united = part if united is None else united.unionByName(part)
    if united is None:
        raise FileNotFoundError("all capture files are empty")
    return united


def read_upload(spark: SparkSession, path: str, on_bad: str = "drop") -> DataFrame:
    """A single uploaded CSV table; empty or unusable tables are rejected."""
    header = _header(spark, path)
    if not header[1]:
        raise ValueError("the table is empty")
    raw = _scan(spark, header, [path])
    if raw.isEmpty():
        raise ValueError("the table is empty")
    cleaned = canonicalise(raw, on_bad=on_bad, keep={"source_file": F.col("_file")}, transport=True)
    if cleaned.isEmpty():
        raise ValueError("no usable rows after cleaning")
    return cleaned.withColumn("coverage", F.lit(feature_coverage(header[1], False)))


def read_soc_events(spark: SparkSession, path: str, fallback: DataFrame | None = None) -> tuple[DataFrame, str]:
    """SOC events with parsed timestamps, and which source they came from."""
    try:
        raw = spark.read.csv(path, header=True, schema=S.SOC_EVENT_SCHEMA)
        source = "file"
    except AnalysisException:
        if fallback is None:
            raise FileNotFoundError(f"no SOC event table at {path}") from None
        raw, source = fallback, "fallback"
    return raw.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp").cast("string"))), source


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """A run-state document; a missing or broken one reads as no rows."""
    try:
        document = spark.read.json(path, schema=S.STATE_SCHEMA, multiLine=True, mode="DROPMALFORMED")
        return document.filter(F.col("events_captured").isNotNull())
    except AnalysisException:
        return spark.createDataFrame([], S.STATE_SCHEMA)


def state_log(document: DataFrame) -> DataFrame:
    """The decision log inside a run-state document."""
    return document.select(F.inline("logs"))
