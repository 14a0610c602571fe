"""Per-source behaviour windows as keyed streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtriage import schema as S
from flowtriage.functions.flow import micros_of, source_key
from flowtriage.operators.behaviour import ATTRIBUTES, MEASURES, behaviour_score, stream_measures

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BUFFER_SCHEMA = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("port", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("size", T.DoubleType()),
        T.StructField("sent", T.DoubleType()),
    ]
)
#: What the state hands on: the flows of a source's windows in order, the buffered ones marked as halo.
OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("_src", T.StringType()),
        T.StructField("_run", T.LongType()),
        T.StructField("src_rank", T.LongType()),
        T.StructField("_old", T.BooleanType()),
        T.StructField("_halo", T.BooleanType()),
        T.StructField("_us", T.LongType()),
    ]
    + [f for f in BUFFER_SCHEMA if f.name != "us"]
)
#: Run of the flows without a time, which belong to no window.
UNTIMED = -1


def _whole(value) -> int | None:
    """An integer of a pandas column, which holds floats where there are nulls."""
    return None if pd.isna(value) else int(value)


class SourceWindow(StatefulProcessor):
    """Keeps the last ``max_flows`` flows of a source; hands them on once, followed by the new ones.

    Every flow leaves once per batch, not once per window it is in, so a batch
    costs its rows and the buffers of its sources. A row whose ``control`` is 'reset' empties the source's buffer. State of
    silent sources expires after ``ttl_ms``, if given.
    """

    def __init__(self, max_flows: int, ttl_ms: int | None) -> None:
        self.max_flows = max_flows
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("flows", BUFFER_SCHEMA, ttlDurationMs=self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A buffer handed over from elsewhere (see ``read_buffers``): its flows in time order, the last ``max_flows`` kept."""
        ordered = initialState.sort_values(["us", "position"], kind="stable").tail(self.max_flows)
        kept = list(zip(ordered["us"], ordered["port"], ordered["duration"], ordered["size"], ordered["sent"]))
        if kept:
            self.buffer.put(kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch of one source; the trigger bounds its size.
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if len(batch) > 1:
            batch = batch.sort_values(["us", "flow_id"], kind="stable")
        kept = list(self.buffer.get()) if self.buffer.exists() else []
        # src_rank carries the flow's id; a reset begins another run.
        result = [(key[0], 0, 0, False, True, *flow) for flow in kept if flow[0] is not None]
        run = 0
        for flow_id, us, port, duration, size, sent, control in zip(
            batch["flow_id"], batch["us"], batch["dst_port"], batch["flow_duration"],
            batch["pkt_size_avg"], batch["totlen_fwd_pkts"], batch["control"],
        ):
            if control == "reset":
                kept = []
                run += 1
                continue
            flow = (_whole(us), _whole(port), duration, size, sent)
            kept.append(flow)
            result.append((key[0], UNTIMED if flow[0] is None else run, flow_id, False, False, *flow))
        kept = kept[-self.max_flows :]
        if kept:
            self.buffer.put(kept)
        else:
            self.buffer.clear()
        yield pd.DataFrame(result, columns=OUTPUT_SCHEMA.names)

    def close(self) -> None:
        pass


def stream_behaviour(
    flows: DataFrame,
    window_seconds: int = S.BEHAVIOUR_WINDOW_SECONDS,
    max_flows: int = S.BEHAVIOUR_MAX_FLOWS,
    ttl_hours: int | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Behaviour columns and score of every streamed flow.

    ``initial`` (columns src_key, position, us, port, duration, size, sent, as
    ``read_buffers`` gives them) fills the buffers before the first batch of a
    query that starts without a checkpoint.

    The state only keeps flows; behind it the measures of many sources are taken
    in one pass, as on tables. ``src_ip`` comes out as the key: the source, or one made of the
    destination port where a flow has none.

    Flows of one source must arrive in time order between micro-batches;
    within one they are ordered here. A source's share of a micro-batch is
    handled by one task, so limit the batch (``maxFilesPerTrigger`` and the
    like) when one source dominates the input.

    ``ttl_hours`` drops the state of sources silent for that long. Expiry needs
    processing time, which never runs dry, so use it with a continuous trigger
    and leave it unset for ``availableNow`` runs.
    """
    flows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    if "control" not in flows.columns:
        flows = flows.withColumn("control", F.lit(None).cast("string"))
    narrow = flows.select(
        F.coalesce(source_key(F.col("src_ip"), F.col("dst_port")), F.lit("row_")).alias("src_key"),
        F.col("flow_id").cast("long").alias("flow_id"),
        micros_of(F.col("ts"), dict(flows.dtypes)["ts"]).alias("us"), *ATTRIBUTES, "control",
    )
    windows = narrow.groupBy("src_key").transformWithStateInPandas(
        SourceWindow(max_flows, ttl_hours * 3_600_000 if ttl_hours else None),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="append",
        timeMode="ProcessingTime" if ttl_hours else "None",
        initialState=None if initial is None else initial.groupBy("src_key"),
    )
    span = window_seconds * 1_000_000
    # No shuffle lies between: a source's flows arrive together, in the order the state hands them on.
    found = windows.mapInPandas(lambda batches: stream_measures(batches, span, max_flows, True), MEASURES).select(
        F.col("_src").alias("src_ip"), F.col("src_rank").alias("flow_id"), *S.BEHAVIOUR_COLUMNS
    )
    return found.withColumn("behaviour_score", behaviour_score())


def read_buffers(spark, checkpoint: str) -> DataFrame:
    """The buffers a query left in its checkpoint, read by the state store reader: one row per kept flow, in buffer order."""
    spark.streams.active  # the reader needs the state store coordinator, which the query manager starts
    state = (
        spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "flows")
        .option("flattenCollectionTypes", "false").load()
    )
    return state.select(F.col("key.src_key").alias("src_key"), F.posexplode("list_value").alias("position", "flow")).select(
        "src_key", "position", *[F.col(f"flow.{f.name}").alias(f.name) for f in BUFFER_SCHEMA]
    )
