"""Streaming jobs: scoring, metrics, learning, progress, dead letters, windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from flowtriage import schema as S
from flowtriage.functions import flow, triage
from flowtriage.operators import behaviour, clean, metrics, models, ordered, policy
from flowtriage.sources.sinks import load_policy, load_version, save_policy, save_version
from flowtriage.sources.workspace import exists, new_folder

SPECIALISTS = ("auth", "web", "flood")


def file_stream(spark: SparkSession, folder: str, schema, pattern: str = "*", files_per_trigger: int = 1_000) -> DataFrame:
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def triage_flows(
    flows: DataFrame, score: str = "threat_score", ports: tuple[str, ...] = ("dst_port", "src_port"),
    source_file: str | None = None, packet_rate: str | None = None,
) -> DataFrame:
    """Route, threshold action, level and outcome; the same on tables and streams.

    Unlabelled flows count as threats here: a stream has no 'unknown' class.
    """
    s = F.col(score)
    routed = flows.withColumn(
        "route",
        models.route(
            [F.col(p) for p in ports if p in flows.columns],
            F.col(source_file) if source_file else None,
            F.col(packet_rate) if packet_rate else None,
        ),
    )
    return _acted(routed, s, F.col("label"))


def triage_raw(
    raw: DataFrame, detectors: dict, calibrators: dict, source_file: str, keep: Mapping[str, str] | None = None
) -> DataFrame:
    """From raw flows in any dialect to actions, with stored detectors; the same on tables and streams.

    Flows are made canonical, routed by ports, capture file and packet rate
    (the flood route exists on streams only), scored by the detector of their
    route and calibrated. Rows with missing or infinite features are dropped;
    set them aside first with ``split_valid`` if they are wanted.
    """
    carried = {"_file": source_file, **(keep or {})}
    flows = clean.canonicalise(raw, keep=carried, transport=True)
    ports = [F.col("`Dst Port`"), F.col("src_port")]
    routed = flows.withColumn("route", models.route(ports, F.col("_file"), F.col("`Flow Pkts/s`").cast("double")))
    scored = models.score_with_routes(routed, detectors, calibrators)
    return _acted(scored, F.col("threat_score"), F.col("Label")).drop("_file")


def _acted(routed: DataFrame, score: Column, label: Column) -> DataFrame:
    """Truth, threshold action, level and outcome of routed flows."""
    acted = routed.withColumns(
        {
            "y": flow.binary_label(F.coalesce(label, F.lit("Unknown"))),
            "action": triage.threshold_action(score, F.col("route").isin(*SPECIALISTS)),
            "level": triage.threat_level(score),
        }
    )
    return acted.withColumn("outcome", triage.outcome(F.col("y"), F.col("action") >= 1))


def run_to_table(stream: DataFrame, output_mode: str = "append", purpose: str = "stream") -> DataFrame:
    """Process everything available into a table (exactly-once file sink) and read it."""
    spark = stream.sparkSession
    path = new_folder(spark, purpose)
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", new_folder(spark, f"{purpose}-progress"))
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame, handle, output_mode: str = "append", checkpoint: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Feed micro-batches to ``handle(batch, batch_id)``.

    Without ``every`` all that is available is processed before the call
    returns; with it ("10 seconds") the query goes on and is returned running.
    """
    spark = stream.sparkSession
    trigger = {"processingTime": every} if every else {"availableNow": True}
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint or new_folder(spark, "batches-progress"))
        .outputMode(output_mode)
        .trigger(**trigger)
        .start()
    )
    if not every:
        query.awaitTermination()
    return query


def running_metrics(triaged: DataFrame) -> DataFrame:
    """Cumulative confusion and rates of a stream (use complete or update mode)."""
    counts = metrics.confusion(triaged, F.col("y"), F.col("action") >= 1)
    rates = triage.running_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return counts.select("*", *[F.bround(e, 4).alias(n) for n, e in rates.items()])


def latest_metrics(triaged: DataFrame) -> DataFrame:
    """Metrics after the last available flow, each batch's result kept as a version."""
    spark = triaged.sparkSession
    folder = new_folder(spark, "metrics")
    run_batches(
        running_metrics(triaged), lambda batch, number: save_version(batch.coalesce(1), folder, number), "complete"
    )
    return load_version(spark, folder)[0]


def stream_header(triaged: DataFrame) -> DataFrame:
    """Totals announced before a stream starts."""
    return triaged.agg(
        F.count("*").alias("total"), F.count_if(F.col("y") == 1).alias("n_attacks"), F.count_if(F.col("y") == 0).alias("n_benign")
    )


def stream_summary(triaged: DataFrame) -> DataFrame:
    """Total, confusion and rates after the last flow, in one row."""
    return running_metrics(triaged).withColumn("total", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))


def split_valid(records: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Usable rows and dead letters: a bad record is set aside, the stream goes on."""
    usable = F.lit(True)
    for column in required:
        usable = usable & F.coalesce(flow.is_finite(F.col(column).try_cast("double")), F.lit(False))
    tagged = records.withColumn("_usable", usable)
    return tagged.filter("_usable").drop("_usable"), tagged.filter("NOT _usable").drop("_usable")


class DeadLetters:
    """foreachBatch handler: every batch read once and written once, usable rows and dead letters as two partitions.

    A repeated batch overwrites its own folder, so a retried micro-batch leaves
    no duplicates.
    """

    def __init__(self, folder: str, required: list[str]) -> None:
        self.root, self.required = folder.rstrip("/"), list(required)

    def __call__(self, batch: DataFrame, number: int) -> None:
        usable = F.lit(True)
        for column in self.required:
            usable = usable & F.coalesce(flow.is_finite(F.col(column).try_cast("double")), F.lit(False))
        tagged = batch.withColumn("part", F.when(usable, "usable").otherwise("dead"))
        tagged.write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/batch={number}")

    def read(self, spark: SparkSession, schema) -> tuple[DataFrame, DataFrame]:
        """Usable rows and dead letters of all batches so far."""
        if not exists(spark, self.root):
            empty = spark.createDataFrame([], schema)
            return empty, empty
        found = spark.read.option("basePath", self.root).parquet(f"{self.root}/batch=*")
        columns = [f.name for f in schema]
        return found.where("part = 'usable'").select(*columns), found.where("part = 'dead'").select(*columns)


def windowed_behaviour(flows: DataFrame, delay: str = "60 seconds", length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Sliding event-time windows per source with late-data handling; on a table, all windows."""
    timed = flows.withColumn("ts", F.col("ts").cast("timestamp"))
    if flows.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy("src_ip", F.window("ts", length, slide).alias("w")).agg(
        F.count("*").alias("flows"),
        F.count_if(F.col("flow_duration") < S.SHORT_FLOW_MICROS).alias("short"),
        # Exact; a window holds at most 65,536 ports.
        F.size(F.collect_set("dst_port")).cast("long").alias("ports"),
        F.avg("flow_duration").alias("avg_duration"),
    ).select("src_ip", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "flows", "short", "ports", "avg_duration")


def all_windows(
    stream: DataFrame, flows: DataFrame, delay: str = "60 seconds", length: str = "60 seconds", slide: str = "10 seconds"
) -> DataFrame:
    """Every window of a finished stream: those it closed, and those still open at its end.

    Append mode holds a window back until the watermark passes its end. The
    open ones are computed from ``flows``, the table behind the stream, of
    which only the last window's length and delay are read.
    """
    closed = run_to_table(windowed_behaviour(stream, delay, length, slide))
    span = F.expr(f"INTERVAL {length}") + F.expr(f"INTERVAL {delay}")
    last = flows.agg(F.max(F.col("ts").cast("timestamp")).alias("t")).scalar()
    recent = flows.filter(F.col("ts").cast("timestamp") >= last - span)
    # A window that starts before the rows read is closed already.
    whole = F.col("window_start") >= last - span
    late = windowed_behaviour(recent, delay, length, slide).filter(whole)
    still_open = ordered.null_safe_join(late, closed.select("src_ip", "window_start"), ["src_ip", "window_start"], "left_anti")
    return closed.unionByName(still_open)


class BehaviourBatches:
    """Exact behaviour windows over micro-batches of any size and skew.

    Each batch runs the split window operator with the stored last flows of
    every source as history, then stores the new last flows. Steps must rise
    from batch to batch. A row whose ``control`` is 'reset' clears its source.
    """

    def __init__(
        self, folder: str, window_seconds: int = S.BEHAVIOUR_WINDOW_SECONDS,
        max_flows: int = S.BEHAVIOUR_MAX_FLOWS, block_rows: int = ordered.BLOCK_ROWS,
    ) -> None:
        self.root = folder.rstrip("/")
        self.seconds, self.max_flows, self.block_rows = window_seconds, max_flows, block_rows

    @property
    def results_folder(self) -> str:
        return f"{self.root}/results"

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        reset = F.col("control") == "reset" if "control" in batch.columns else None
        history, _ = load_version(spark, f"{self.root}/tails", at_most=number)
        everything = batch
        if history is not None:
            history = history.withColumn("ts", F.col("ts").cast(batch.schema["ts"].dataType))
            everything = batch.unionByName(history, allowMissingColumns=True)
        measured = behaviour.behaviour_features(
            batch, self.seconds, self.max_flows, history=history, block_rows=self.block_rows, reset=reset,
            keep=[c for c in batch.columns if c != "control"],
        )
        save_version(measured, self.results_folder, number)
        save_version(
            behaviour.behaviour_tail(everything, self.max_flows, block_rows=self.block_rows, reset=reset),
            f"{self.root}/tails", number + 1,
        )


class OnlineLearner:
    """Per micro-batch: decide with the stored policy, learn, store the next version.

    The policy is frozen inside a batch. Version n + 1 and the decisions of
    batch n depend on version n only, so a repeated batch rewrites the same
    files. The last 100 scores travel along for the threat density.
    """

    def __init__(self, folder: str, load: Column | str = "analyst_load", score: str = "threat_score", learn: bool = True) -> None:
        self.root = folder.rstrip("/")
        self.load, self.score, self.learn = load, score, learn

    @property
    def policy_folder(self) -> str:
        return f"{self.root}/policy"

    @property
    def decisions_folder(self) -> str:
        return f"{self.root}/decisions"

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        known, _ = load_policy(spark, self.policy_folder, at_most=number)
        tail, _ = load_version(spark, f"{self.root}/scores", at_most=number)
        flows = batch.withColumn("_old", F.lit(False))
        if tail is not None:
            flows = flows.unionByName(tail.withColumn("_old", F.lit(True)), allowMissingColumns=True)
        dense = ordered.threat_density(flows, self.score)
        load = F.col(self.load) if isinstance(self.load, str) else self.load
        decided = policy.decide(dense.filter(~F.col("_old")).drop("_old"), known, self.score, load)
        logged = decided.withColumn(
            "reward", triage.reward(F.col("y"), F.col("action"), load, F.col(self.score))
        )
        # Written first, so learning and later batches read files, not a replay of the input.
        save_version(logged, self.decisions_folder, number)
        done = spark.read.parquet(f"{self.decisions_folder}/version={number}")
        recent = done.select("step", self.score).orderBy(F.desc("step")).limit(S.DENSITY_ROWS)
        if tail is not None:
            recent = recent.unionByName(tail).orderBy(F.desc("step")).limit(S.DENSITY_ROWS)
        save_version(recent.coalesce(1), f"{self.root}/scores", number + 1)
        if self.learn:
            after = triage.state_columns(F.col(self.score), load, F.col("density_after"), F.col("dst_port"))
            labelled = done.filter(F.col("y").isNotNull()).withColumns(after)
            save_policy(policy.fold_updates(labelled, known), self.policy_folder, number + 1)


class ProgressWriter:
    """Running metrics at every ``every``-th step, continued over micro-batches."""

    def __init__(self, folder: str, every: int = 5_000, block_rows: int = ordered.BLOCK_ROWS) -> None:
        self.root, self.every, self.block_rows = folder.rstrip("/"), every, block_rows

    def __call__(self, batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        names = ["tp", "fp", "fn", "tn", "cumulative_reward"]
        before, _ = load_version(spark, f"{self.root}/totals", at_most=number)
        base = before.first().asDict() if before is not None else dict.fromkeys(names, 0)  # one row
        series = ordered.running_confusion(
            batch, "y", F.col("action") >= 1, F.col("action") == 2, block_rows=self.block_rows,
            extra={"cumulative_reward": F.col("reward")},
        ).withColumns({n: F.col(n) + F.lit(base[n]) for n in names})
        rates = triage.running_rates(*[F.col(c) for c in names[:4]])
        snapshots = series.filter(F.col("step") % self.every == 0).select("step", *names, *[e.alias(n) for n, e in rates.items()])
        save_version(snapshots, f"{self.root}/snapshots", number)
        last = series.orderBy(F.desc("step")).limit(1).select(*names)
        save_version(last, f"{self.root}/totals", number + 1)
