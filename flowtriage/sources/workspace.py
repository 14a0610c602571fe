"""Places for intermediate tables that outlive a lost executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made by this process and not yet deleted.
_MADE: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local master without one gets a temporary folder.

    On a cluster a machine's own folder would lose every other machine's part,
    so there the setting is required. The context's own checkpoint folder is set along with it when missing, so
    iterative fits can cut their lineage too.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    root = named or current
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="flowtriage-")
    if not current:
        context.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, never reused path below the checkpoint folder."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far; call it when no result that reads them is needed any more."""
    removed = 0
    while _MADE:
        place, system = _located(spark, _MADE.pop())
        removed += bool(system.delete(place, True))
    return removed


def _located(spark: SparkSession, path: str):
    """A path of any store Spark knows, and that store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _located(spark, path)
    return system.exists(place)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is absent. Other faults are raised."""
    place, system = _located(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def durable(df: DataFrame, purpose: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage."""
    path = new_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
