"""Keyed behaviour state across micro-batches, restarts and a hand-over to a fresh query.

Input arrives in parts, in step order. The first leg is one streaming query
that is stopped after every part and started again from its checkpoint, so
its RocksDB state crosses restarts. After ``hand_over`` parts the buffers are
read out of that checkpoint with the state store reader and given to a new
query, with a checkpoint of its own, as its initial state; it takes the
remaining parts the same way. Together the two legs give every flow's window
exactly as one uninterrupted run would.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from flowtriage import schema as S
from flowtriage.sources.workspace import new_folder
from flowtriage.streaming.behaviour_state import read_buffers, stream_behaviour

RESULT_SCHEMA = T.StructType(
    [T.StructField("src_ip", T.StringType()), T.StructField("flow_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in (*S.BEHAVIOUR_COLUMNS, "behaviour_score")]
)


def step_ranges(rows: DataFrame, column: str, parts: int) -> list[tuple[int, int]]:
    """``parts`` half-open ranges of equal width that cover the column's values (none for an empty table)."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None:
        return []
    width = (high - low) // parts + 1
    return [(low + k * width, low + (k + 1) * width) for k in range(parts)]


@dataclass
class Leg:
    """One streaming query: the folder it reads, its checkpoint and its output."""

    inputs: str
    checkpoint: str
    output: str
    batches: int = 0

    def run(self, spark: SparkSession, schema: T.StructType, prepare: Callable[[DataFrame], DataFrame], initial=None, **window) -> None:
        stream = prepare(spark.readStream.schema(schema).parquet(f"{self.inputs}/*"))
        query = (
            stream_behaviour(stream, initial=initial, **window)
            .writeStream.format("parquet")
            .option("path", self.output)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        self.batches += sum(1 for p in query.recentProgress if p["numInputRows"])


def behaviour_over_parts(
    events: DataFrame,
    prepare: Callable[[DataFrame], DataFrame],
    order: str,
    parts: int = 4,
    hand_over: int = 2,
    **window,
) -> tuple[DataFrame, Leg, Leg]:
    """Behaviour of every flow, fed part by part; the rows of both legs and the legs themselves.

    ``prepare`` turns the streamed raw rows into flows (and may add a
    ``control`` column); ``order`` is the raw column that orders them.
    """
    spark = events.sparkSession
    first, second = (Leg(*(new_folder(spark, f"keyed-{leg}-{what}") for what in ("in", "state", "out"))) for leg in (1, 2))
    initial = None
    for k, (low, high) in enumerate(step_ranges(events, order, parts)):
        leg = first if k < hand_over else second
        events.where((F.col(order) >= low) & (F.col(order) < high)).write.parquet(f"{leg.inputs}/part-{k}")
        if k == hand_over:
            initial = read_buffers(spark, first.checkpoint)
        leg.run(spark, events.schema, prepare, initial if leg is second else None, **window)
    found = [spark.read.schema(RESULT_SCHEMA).parquet(leg.output) for leg in (first, second) if leg.batches]
    result = found[0] if found else spark.createDataFrame([], RESULT_SCHEMA)
    for more in found[1:]:
        result = result.unionByName(more)
    return result, first, second


def last_state(spark: SparkSession, first: Leg, second: Leg) -> DataFrame:
    """The buffers after the last part: those of the second leg, or of the first if no part reached the second."""
    leg = second if second.batches else first
    if not leg.batches:
        return spark.createDataFrame([], "src_key string, position int, us long, port int, duration double, size double, sent double")
    return read_buffers(spark, leg.checkpoint)
