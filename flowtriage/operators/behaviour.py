"""Per-source sliding-window behaviour features.

A flow's window is the last ``max_flows`` flows of its source that are not
older than ``window_seconds``, itself included. Windows are contiguous ranges
whose ends only move forward, so one pass of prefix sums over a run of flows
measures all of them: a flow costs the same whatever ``max_flows`` is.

No source has to fit one task: flows are ranked within their source and cut
into runs of ``block_rows``, each run preceded by a halo of ``max_flows - 1``
flows. That halo is all a window can reach, so the result is exact for any
distribution of flows over sources. Most sources are small, so a task measures
many runs in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from flowtriage import schema as S
from flowtriage.functions.flow import micros_of, source_key
from flowtriage.operators.ordered import BLOCK_ROWS, block_of, preceding_totals

# Columns a flow needs: key, order, time and the four observed attributes.
ATTRIBUTES = ("dst_port", "flow_duration", "pkt_size_avg", "totlen_fwd_pkts")


# Ranking streams through a group once, so its blocks may be larger.
RANK_BLOCKS = 64
#: Flows of a run: measuring costs up to ``max_flows`` steps a flow, so runs are short; the halo adds 2.5 %.
RUN_ROWS = 8_192


def with_source_rank(flows: DataFrame, source: str, step: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``src_rank``: 1, 2, ... within a source in step order; no source is a source of its own.

    Flows of one source are ranked inside step blocks first; counts of the
    earlier blocks, aggregated map-side, lift the local rank to a global one.
    """
    block_rows *= RANK_BLOCKS
    keys = ("_kn", "_kv", "_sb")
    based = _with_plain_key(flows, source).withColumn("_sb", block_of(F.col(step), block_rows))
    counts = based.groupBy(*keys).agg(F.count("*").alias("n"))
    offsets = preceding_totals(counts, "_sb", ["n"], keys=keys[:2])
    local = based.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(step)))
    return (
        local.join(offsets, list(keys))
        .withColumn("src_rank", F.col("_rn") + F.col("before_n"))
        .drop("_rn", "before_n", *keys)
    )


def _with_plain_key(flows: DataFrame, source: str) -> DataFrame:
    """Two columns without nulls that identify the source, so equi-joins and windows share a partitioning."""
    key = F.col(source).cast("string")
    return flows.withColumns({"_kn": key.isNull(), "_kv": F.coalesce(key, F.lit(""))})


def reset_spells(
    flows: DataFrame, reset: Column, source: str = "src_ip", step: str = "step", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``spell``: how many resets of its source a flow has seen.

    Clearing a source's window is the same as giving its later flows a new
    key. Resets are summed per step block first, so hot sources stay split.
    """
    flag = F.coalesce(reset, F.lit(False)).cast("long")
    keys = ("_kn", "_kv", "_sb")
    based = _with_plain_key(flows, source).withColumns(
        {"_sb": block_of(F.col(step), block_rows * RANK_BLOCKS), "_flag": flag}
    )
    totals = based.groupBy(*keys).agg(F.sum("_flag").alias("resets"))
    offsets = preceding_totals(totals, "_sb", ["resets"], keys=keys[:2])
    within = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return (
        based.withColumn("_in", F.sum("_flag").over(within))
        .join(offsets, list(keys))
        .withColumn("spell", F.col("_in") + F.col("before_resets"))
        .drop("_flag", "_in", "before_resets", *keys)
    )


def observed(micros: Column) -> Column:
    """What a window keeps of a flow."""
    return F.struct(
        micros.alias("us"),
        F.col("dst_port").cast("int").alias("port"),
        F.col("flow_duration").cast("double").alias("duration"),
        F.col("pkt_size_avg").cast("double").alias("size"),
        F.col("totlen_fwd_pkts").cast("double").alias("sent"),
    )


def _mean(values: Column) -> Column:
    """Mean of the non-null values; null if there is none."""
    known = F.array_compact(values)
    return F.aggregate(known, F.lit(0.0), lambda total, x: total + x) / F.nullif(F.size(known), F.lit(0))


def recent(window: Column, window_seconds: int) -> Column:
    """The flows of a window, oldest first, that are not too old for its last one."""
    oldest = F.element_at(window, -1)["us"] - window_seconds * 1_000_000
    return F.filter(window, lambda flow: flow["us"] >= oldest)


def measured(flows: DataFrame, window: str, timed: bool = True) -> DataFrame:
    """Add the seven behaviour columns from ``window``, an array of ``observed`` flows, the current one last.

    The windows hold at most ``max_flows`` flows, so a row costs that many
    steps whatever its source has sent.
    """
    w = F.col(window)
    n = F.size(w)
    elapsed = F.greatest(F.lit(1.0), (F.element_at(w, -1)["us"] - w[0]["us"]) / 1e6) if timed else F.lit(1.0)
    sizes = flows.withColumns(
        {"_sizes": F.array_compact(F.transform(w, lambda flow: flow["size"])), "_n": n}
    ).withColumn("_mean", _mean(F.col("_sizes")))
    mean = F.col("_mean")
    return sizes.withColumns(
        {
            "beh_conn_rate_per_min": n / elapsed * 60.0,
            "beh_short_flow_ratio": F.size(F.filter(w, lambda f: f["duration"] < S.SHORT_FLOW_MICROS)) / n,
            "beh_unique_dst_ports": F.size(F.array_distinct(F.array_compact(F.transform(w, lambda f: f["port"])))).cast("double"),
            "beh_pkt_size_std": F.sqrt(_mean(F.transform("_sizes", lambda x: (x - mean) * (x - mean)))),
            "beh_flow_count_window": n.cast("double"),
            "beh_large_payload_ratio": F.size(F.filter(w, lambda f: f["sent"] > S.LARGE_PAYLOAD_BYTES)) / n,
            "beh_avg_duration": _mean(F.transform(w, lambda f: f["duration"])),
        }
    ).drop("_sizes", "_n", "_mean")


def behaviour_features(
    flows: DataFrame,
    window_seconds: int = S.BEHAVIOUR_WINDOW_SECONDS,
    max_flows: int = S.BEHAVIOUR_MAX_FLOWS,
    source: str = "src_ip",
    step: str = "step",
    ts: str = "ts",
    mode: str = "event_time",
    history: DataFrame | None = None,
    block_rows: int = RUN_ROWS,
    reset: Column | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add the seven behaviour columns and ``behaviour_score``.

    ``mode="event_time"`` ages flows by ``ts``; ``step`` must not decrease with
    ``ts`` and flows sharing a timestamp count only those up to their own step.
    ``mode="arrival"`` treats the table as arriving at one instant: only the
    row cap applies and elapsed time is one second. ``history`` holds flows
    seen earlier (see ``behaviour_tail``); they feed windows but are not
    returned, and must precede all flows in step order. A flow without a source
    is keyed by its destination port (see ``source_key``); no row is lost.
    A row for which ``reset`` is true clears its source (or port key) and is
    not returned. ``keep`` names the columns to return beside the new ones, all
    by default: rows go through the measuring tasks, so unwanted columns cost.
    """
    if mode not in ("event_time", "arrival"):
        raise ValueError("mode must be 'event_time' or 'arrival'")
    columns = list(flows.columns if keep is None else keep)
    micros = micros_of(F.col(ts), dict(flows.dtypes)[ts]) if mode == "event_time" else F.lit(0).cast("long")
    if history is not None:
        flows = flows.withColumn("_old", F.lit(False)).unionByName(
            history.withColumn("_old", F.lit(True)), allowMissingColumns=True
        )
    else:
        flows = flows.withColumn("_old", F.lit(False))
    carried = {f"_c{i}": c for i, c in enumerate(columns)}
    cleared = [] if reset is None else [F.coalesce(reset, F.lit(False)).alias("_reset")]
    keyed = flows.select(
        _source_of(source), F.col(step).alias("_step"), "_old", micros.alias("_us"),
        F.col("dst_port").cast("int").alias("port"), F.col("flow_duration").cast("double").alias("duration"),
        F.col("pkt_size_avg").cast("double").alias("size"), F.col("totlen_fwd_pkts").cast("double").alias("sent"),
        *cleared, *[F.col(f"`{c}`").alias(n) for n, c in carried.items()],
    )
    runs = _runs(keyed, max_flows, block_rows).repartition("_src", "_run")
    order = ["_src", "_run", "_us", "_step"]
    if reset is not None:
        # A run's resets cut it further; counted in step order behind the same shuffle.
        seen = Window.partitionBy("_src", "_run").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
        runs = runs.withColumn("_spell", F.sum(F.col("_reset").cast("long")).over(seen)).filter(~F.col("_reset")).drop("_reset")
        order.insert(2, "_spell")
    timed, span = mode == "event_time", window_seconds * 1_000_000
    kinds = runs.schema
    schema = T.StructType(
        [T.StructField(n, kinds[n].dataType) for n in carried] + [T.StructField(c, T.DoubleType()) for c in S.BEHAVIOUR_COLUMNS]
    )
    names, marks = list(carried), order[:-2]
    found = runs.sortWithinPartitions(*order).mapInArrow(
        lambda batches: carry_measures(batches, names, marks, span, max_flows, timed), schema
    )
    return found.select(
        *[F.col(n).alias(c) for n, c in carried.items()], *S.BEHAVIOUR_COLUMNS
    ).withColumn("behaviour_score", behaviour_score())


def _source_of(source: str) -> Column:
    return F.coalesce(source_key(F.col(source), F.col("dst_port")), F.lit("row_")).alias("_src")


#: A source of at most this many runs is one run: a task streams through it, no rank needed.
WHOLE_RUNS = 4


def _runs(keyed: DataFrame, max_flows: int, block_rows: int) -> DataFrame:
    """Add ``_run`` and ``_halo``: small sources whole, others cut by rank into runs that begin with a halo.

    Only the names of the large sources are broadcast, at most one per
    ``WHOLE_RUNS * block_rows`` flows, and only their flows are ranked.
    """
    sizes = keyed.groupBy("_src").agg(F.count("*").alias("n"))
    large = F.broadcast(sizes.filter(F.col("n") > WHOLE_RUNS * block_rows).select("_src"))
    whole = keyed.join(large, "_src", "left_anti").withColumns({"_run": F.lit(0).cast("long"), "_halo": F.lit(False)})
    ranked = with_source_rank(keyed.join(large, "_src", "left_semi"), "_src", "_step", block_rows)
    own = block_of(F.col("src_rank"), block_rows)
    last = block_of(F.col("src_rank") + (max_flows - 1), block_rows)
    cut = ranked.withColumn("_own", own).withColumn("_run", F.explode(F.sequence("_own", last)))
    return whole.unionByName(cut.withColumn("_halo", F.col("_run") != F.col("_own")).drop("src_rank", "_own"))


MEASURES = "_src string, src_rank long, " + ", ".join(f"{c} double" for c in S.BEHAVIOUR_COLUMNS)


def _exact(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Doubles as Python integers over one power-of-two denominator, so sums and squares are exact."""
    ratios = [v.as_integer_ratio() for v in values.tolist()]
    scale = max((d for _, d in ratios), default=1)
    return np.array([n * (scale // d) for n, d in ratios] or [], dtype=object), scale


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def window_measures(run: pd.DataFrame, span_us: int, max_flows: int, timed: bool) -> pd.DataFrame:
    """The seven behaviour columns of the own flows of one run, in one pass whatever ``max_flows`` is."""
    ordered = run.sort_values(["_us", "_step"], na_position="first", kind="stable").reset_index(drop=True)
    return _measured_runs(ordered, np.zeros(len(ordered), dtype=np.int64), span_us, max_flows, timed)


#: Flows measured at a time; sources are mostly small, so one pass takes many runs.
CHUNK_ROWS = 50_000


def stream_measures(batches: Iterator[pd.DataFrame], span_us: int, max_flows: int, timed: bool) -> Iterator[pd.DataFrame]:
    """``window_measures`` of a partition's runs, which come sorted by source, run, time and step.

    Whole chunks are measured, however many runs they hold. A run that goes on
    in the next chunk leaves its last ``max_flows - 1`` flows there as a halo,
    so memory is bounded by the chunk and ``max_flows``.
    """
    held: list[pd.DataFrame] = []
    own = 0

    def measure() -> pd.DataFrame:
        chunk = pd.concat(held, ignore_index=True)
        first = _first_of_run(chunk)
        rest = chunk.iloc[max(int(first[-1]), len(chunk) - (max_flows - 1)) :]
        held[:] = [rest.assign(_halo=True)] if len(rest) else []
        return _measured_runs(chunk, first, span_us, max_flows, timed)

    for batch in batches:
        if len(batch):
            held.append(batch)
            own += len(batch)
        if own >= max(CHUNK_ROWS, 4 * max_flows):
            own = 0
            yield measure()
    if own:
        yield measure()


def carry_measures(
    batches: Iterator[pa.RecordBatch], carried: list[str], marks: list[str], span_us: int, max_flows: int, timed: bool
) -> Iterator[pa.RecordBatch]:
    """``stream_measures`` that returns the ``carried`` columns of every own flow as they came; a run is one value of ``marks``."""
    held: list[pa.Table] = []
    own = 0

    def measure() -> pa.Table:
        chunk = pa.concat_tables(held).combine_chunks()
        flows = chunk.drop_columns(carried).to_pandas()
        first = _first_of_run(flows, marks)
        begin = max(int(first[-1]), len(flows) - (max_flows - 1))
        rest = chunk.slice(begin)
        place = rest.schema.get_field_index("_halo")
        held[:] = [rest.set_column(place, rest.schema.field(place), pa.array(np.ones(len(rest), dtype=bool)))] if len(rest) else []
        mine = ~(flows["_halo"].to_numpy(dtype=bool) | flows["_old"].to_numpy(dtype=bool))
        found = _all_measures(flows, first, span_us, max_flows, timed)[mine]
        out = chunk.select(carried).filter(pa.array(mine))
        for name in S.BEHAVIOUR_COLUMNS:
            out = out.append_column(name, pa.array(found[name], pa.float64(), from_pandas=True))
        return out

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            own += batch.num_rows
        if own >= max(CHUNK_ROWS, 4 * max_flows):
            own = 0
            yield from measure().to_batches()
    if own:
        yield from measure().to_batches()


def _first_of_run(flows: pd.DataFrame, marks: Sequence[str] = ("_src", "_run")) -> np.ndarray:
    """Per flow the place of its run's first flow."""
    begins = np.r_[True, np.zeros(len(flows) - 1, dtype=bool)]
    for mark in marks:
        value = flows[mark].to_numpy(dtype=object if mark == "_src" else np.int64)
        begins[1:] |= value[1:] != value[:-1]
    return np.maximum.accumulate(np.where(begins, np.arange(len(flows)), 0))


def _first_fresh(us: np.ndarray, first_row: np.ndarray, known: np.ndarray, span_us: int) -> np.ndarray:
    """Per flow with a time the place of the first one of its run that is not older than the span."""
    (place,) = np.nonzero(known)
    times, runs = us[place], first_row[place]
    n = len(place)
    # Merge the limits into the flows' order: a limit comes before a flow of the same time.
    order = np.lexsort((np.r_[np.ones(n), np.zeros(n)], np.r_[times, times - span_us], np.r_[runs, runs]))
    is_flow = order < n
    before = np.cumsum(is_flow)
    found = np.zeros(n, dtype=np.int64)
    found[order[~is_flow] - n] = before[~is_flow]
    out = np.arange(len(us)) + 1
    out[place] = place[found] if n else place
    return out


def _measured_runs(run: pd.DataFrame, first_row: np.ndarray, span_us: int, max_flows: int, timed: bool) -> pd.DataFrame:
    """The behaviour columns of the own flows of ordered runs, with source and rank."""
    out = _all_measures(run, first_row, span_us, max_flows, timed)
    out.insert(0, "_src", run["_src"])
    out.insert(1, "src_rank", run["src_rank"])
    return out[~(run["_halo"].to_numpy() | run["_old"].to_numpy())]


def _all_measures(run: pd.DataFrame, first_row: np.ndarray, span_us: int, max_flows: int, timed: bool) -> pd.DataFrame:
    """The behaviour columns of all flows of ordered runs; ``first_row`` is where a flow's run begins.

    A flow's window is a contiguous range [s, i] of its run in (time, step)
    order: s is the latest of i - max_flows + 1, the run's begin and the first
    flow not older than the span (flows without a time come first and belong to
    no window). Both ends only grow with i, over all runs, so counts and sums
    are differences of prefix sums, and a port counts in the windows from its
    own flow to the last one that still starts at or before it, but only those
    starting after its previous flow: one +1/-1 interval per flow and one
    cumulative sum.
    """
    n_rows = len(run)
    at = np.arange(n_rows)
    known = run["_us"].notna().to_numpy()
    us = run["_us"].fillna(0).to_numpy(dtype=np.int64)
    start = np.maximum(at - (max_flows - 1), first_row)
    if timed:
        start = np.where(known, np.maximum(start, _first_fresh(us, first_row, known, span_us)), at + 1)
    n = at - start + 1
    some = n > 0
    first = np.minimum(start, n_rows - 1)
    elapsed = np.maximum(1.0, (us - us[first]) / 1e6) if timed else np.ones(n_rows)
    duration, size, sent, port = run["duration"], run["size"], run["sent"], run["port"]

    def count(flag: pd.Series) -> np.ndarray:
        total = _prefix(flag.fillna(False).to_numpy(dtype=bool))
        return total[at + 1] - total[start]

    def exact_sums(values: pd.Series):
        present = values.notna().to_numpy()
        ints, scale = _exact(values.to_numpy()[present])
        full = np.zeros(n_rows, dtype=object)
        full[:] = 0
        full[present] = ints
        m = _prefix(present.astype(np.int64))
        s1, s2 = _prefix(full), _prefix(full * full)
        return m[at + 1] - m[start], s1[at + 1] - s1[start], s2[at + 1] - s2[start], scale

    short, large = count(duration < S.SHORT_FLOW_MICROS), count(sent > S.LARGE_PAYLOAD_BYTES)
    m_d, s_d, _, scale_d = exact_sums(duration)
    m_s, s1, s2, scale_s = exact_sums(size)
    mean_duration = [s / (m * scale_d) if m else None for m, s in zip(m_d.tolist(), s_d.tolist())]
    deviation = [
        math.sqrt((m * b - a * a) / (m * m * scale_s * scale_s)) if m else None
        for m, a, b in zip(m_s.tolist(), s1.tolist(), s2.tolist())
    ]
    # distinct ports: flow j counts for windows i in [max(j, first i with s(i) > prev(j)), last i with s(i) <= j]
    ports = pd.DataFrame({"port": port, "j": at})[port.notna()].sort_values(["port", "j"], kind="stable")
    j = ports["j"].to_numpy()
    prev = np.where(ports["port"].to_numpy()[1:] == ports["port"].to_numpy()[:-1], j[:-1], -1) if len(j) else j
    prev = np.r_[-1, prev] if len(j) else prev
    lo = np.maximum(j, np.searchsorted(start, prev, side="right"))
    hi = np.searchsorted(start, j, side="right") - 1
    live = lo <= hi
    change = np.zeros(n_rows + 1, dtype=np.int64)
    np.add.at(change, lo[live], 1)
    np.add.at(change, hi[live] + 1, -1)
    distinct = np.cumsum(change[:-1])
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.DataFrame({
            "beh_conn_rate_per_min": np.where(some, n / elapsed * 60.0, 0.0),
            "beh_short_flow_ratio": np.where(some, short / np.maximum(n, 1), np.nan),
            "beh_unique_dst_ports": distinct.astype(float),
            "beh_pkt_size_std": pd.array(deviation, dtype="Float64"),
            "beh_flow_count_window": n.astype(float),
            "beh_large_payload_ratio": np.where(some, large / np.maximum(n, 1), np.nan),
            "beh_avg_duration": pd.array(mean_duration, dtype="Float64"),
        })


def behaviour_score() -> Column:
    """Weighted, saturated mix of five behaviour columns, within [0, 1]."""
    c = F.col
    one = F.lit(1.0)
    mixed = (
        0.35 * F.least(one, c("beh_conn_rate_per_min") / S.RATE_SATURATION)
        + 0.20 * c("beh_short_flow_ratio")
        + 0.15 * F.least(one, c("beh_unique_dst_ports") / S.PORT_SATURATION)
        + 0.20 * c("beh_large_payload_ratio")
        + 0.10 * F.least(one, c("beh_avg_duration") / S.DURATION_SATURATION)
    )
    return F.greatest(F.lit(0.0), F.least(one, mixed))


def behaviour_vector() -> Column:
    """The seven behaviour columns as one float array, in fixed order."""
    return F.array(*[F.col(c).cast("float") for c in S.BEHAVIOUR_COLUMNS])


#: Up to this rank Spark drops rows before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
PRUNED_RANK = 1_000


def behaviour_tail(
    flows: DataFrame,
    max_flows: int = S.BEHAVIOUR_MAX_FLOWS,
    source: str = "src_ip",
    step: str = "step",
    ts: str = "ts",
    block_rows: int = RUN_ROWS,
    reset: Column | None = None,
) -> DataFrame:
    """The last ``max_flows`` flows of every source: the state a later run needs.

    Only those after the last row for which ``reset`` is true. Every task first
    cuts its share of a source to the last ``max_flows`` rows, so a large source
    is not gathered in one task; for longer tails step blocks are cut first.
    """
    cleared = F.lit(False) if reset is None else F.coalesce(reset, F.lit(False))
    keyed = flows.select(_source_of(source), source, step, ts, *ATTRIBUTES, cleared.cast("long").alias("_reset"))
    latest = F.col(step).desc()
    if max_flows > PRUNED_RANK:
        keyed = keyed.withColumn("_sb", block_of(F.col(step), block_rows * RANK_BLOCKS))
        rank = F.row_number().over(Window.partitionBy("_src", "_sb").orderBy(latest))
        keyed = keyed.withColumn("_rn", rank).filter(F.col("_rn") <= max_flows).drop("_sb", "_rn")
    mine = Window.partitionBy("_src").orderBy(latest)
    last = keyed.withColumn("_rn", F.row_number().over(mine)).filter(F.col("_rn") <= max_flows)
    if reset is not None:
        # Rows come latest first: the sum counts the resets at or after a row.
        later = mine.rowsBetween(Window.unboundedPreceding, 0)
        last = last.withColumn("_later", F.sum("_reset").over(later)).filter(F.col("_later") == 0).drop("_later")
    return last.drop("_src", "_reset", "_rn")


#: Size of stored source sketches: 2^12 registers, relative standard error 1.04 / 64, about 1.6 %.
SKETCH_LG_K = 12


def source_sketches(flows: DataFrame, by: list[str], source: str = "src_ip", lg_k: int = SKETCH_LG_K) -> DataFrame:
    """One mergeable HyperLogLog sketch of the sources per group (a chunk, a day), to be stored and united later."""
    return flows.groupBy(*by).agg(F.hll_sketch_agg(F.col(source).cast("string"), lg_k).alias("sketch"), F.count("*").alias("flows"))


def united_sources(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct sources of any union of stored sketches, without reading a flow again."""
    return sketches.groupBy(*(by or [])).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch", True)).alias("sources"), F.count("*").alias("sketches")
    )


def relative_error_bound(lg_k: int = SKETCH_LG_K, sigmas: float = 3.0) -> float:
    return sigmas * 1.04 / (2 ** lg_k) ** 0.5


def tracked_sources(flows: DataFrame, source: str = "src_ip", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(source) if approximate else F.count_distinct(source)
    return flows.agg(count.alias("sources"))
