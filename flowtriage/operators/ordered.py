"""Globally ordered computations without a single-partition window.

A window with no partition key would pull every row into one task. Here the
dense step number is cut into blocks of equal size; each block is an ordinary
window partition. What crosses a block boundary travels separately: a halo of
the preceding rows for bounded frames, or per-block totals for running sums.
Group sizes are fixed by the block size and do not depend on the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.functions.flow import micros_of, phase_load

BLOCK_ROWS = 65_536
BLOCKS_PER_GROUP = 1_024


def block_of(step: Column, block_rows: int) -> Column:
    """0-based block of a 1-based dense step."""
    return F.floor((step - 1) / block_rows).cast("long")


def with_halo(df: DataFrame, step: Column, block_rows: int, halo_rows: int) -> DataFrame:
    """Add ``block`` and ``halo``; the last rows of a block also join the next ones.

    A row is copied only to blocks that start within ``halo_rows`` steps after
    it, so the overhead is ``halo_rows / block_rows`` of the input.
    """
    own = block_of(step, block_rows)
    last = block_of(step + halo_rows, block_rows)
    return df.withColumn("block", F.explode(F.sequence(own, last))).withColumn(
        "halo", F.col("block") != own
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; the keys of ``left`` stay."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    condition = F.lit(True)
    for key, name in names.items():
        condition = condition & F.col(key).eqNullSafe(F.col(name))
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def row_positions(
    df: DataFrame, step: str, out: str, block_rows: int = BLOCK_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Number rows 1..N along a unique step that may have gaps.

    ``counted`` is a table of the same steps that is cheaper to count than ``df``.
    """
    based = df.withColumn("_pb", block_of(F.col(step), block_rows))
    blocks = (df if counted is None else counted).select(block_of(F.col(step), block_rows).alias("_pb"))
    offsets = preceding_totals(blocks.groupBy("_pb").agg(F.count("*").alias("n")), "_pb", ["n"])
    local = based.withColumn(out, F.row_number().over(Window.partitionBy("_pb").orderBy(step)))
    return local.join(offsets, "_pb").withColumn(out, F.col(out) + F.col("before_n")).drop("_pb", "before_n")


def threat_density(
    df: DataFrame,
    score: str,
    step: str = "step",
    rows: int = S.DENSITY_ROWS,
    block_rows: int = BLOCK_ROWS,
    dense: bool = False,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Mean of the latest ``rows`` scores, without and with the current row.

    ``density_before`` is what a decision sees (0 on the first row),
    ``density_after`` what the following policy update sees. Steps may have
    gaps, as after a filter; rows are then numbered first. ``dense=True`` says
    that the steps are 1..N without gaps and saves that shuffle. ``counted`` is a
    stored table of the same steps, so ``df`` is not computed twice to count them.
    """
    place = step if dense else "_place"
    placed = df if dense else row_positions(df, step, place, block_rows, counted)
    blocked = with_halo(placed, F.col(place), block_rows, rows)
    within = Window.partitionBy("block").orderBy(place)
    before = F.avg(score).over(within.rowsBetween(-rows, -1))
    after = F.avg(score).over(within.rowsBetween(-rows + 1, 0))
    return (
        blocked.withColumn("density_before", F.coalesce(before, F.lit(0.0)))
        .withColumn("density_after", after)
        .filter(~F.col("halo"))
        .drop("block", "halo", "_place")
    )


def preceding_totals(totals: DataFrame, index: str, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Exclusive prefix sums over a table of per-block totals.

    Per key, one window: it sees a row per block, not per input row. Without
    keys the blocks are grouped by 1,024 and summed in two levels, so the only
    pass that is not split any further sees a row per 1,024 blocks.
    """
    if keys:
        earlier = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *keys, index, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"before_{v}") for v in values]
        )
    grouped = totals.withColumn("_group", F.floor(F.col(index) / BLOCKS_PER_GROUP).cast("long"))
    group_totals = grouped.groupBy("_group").agg(*[F.sum(v).alias(v) for v in values])
    earlier_groups = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    group_offsets = group_totals.select(
        "_group", *[F.coalesce(F.sum(v).over(earlier_groups), F.lit(0)).alias(f"_g_{v}") for v in values]
    )
    earlier_blocks = Window.partitionBy("_group").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    within = grouped.select(
        index, "_group", *[F.coalesce(F.sum(v).over(earlier_blocks), F.lit(0)).alias(f"_b_{v}") for v in values]
    )
    return within.join(group_offsets, "_group").select(
        index, *[(F.col(f"_b_{v}") + F.col(f"_g_{v}")).alias(f"before_{v}") for v in values]
    )


def running_sums(
    df: DataFrame,
    values: Mapping[str, Column],
    step: str = "step",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Cumulative sums along the step order.

    ``values`` maps output name to the summed expression. Per-block totals are
    aggregated map-side; they are joined back on the block key the rows are
    already partitioned by, so the rows are shuffled once.
    """
    names = list(values)
    based = df.withColumn("block", block_of(F.col(step), block_rows))
    totals = based.groupBy("block").agg(*[F.sum(values[n]).alias(n) for n in names])
    offsets = preceding_totals(totals, "block", names)
    running = Window.partitionBy("block").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    local = based.select("*", *[F.sum(values[n]).over(running).alias(f"_in_{n}") for n in names])
    joined = local.join(offsets, "block")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(f"_in_{n}") + F.col(f"before_{n}")).alias(n) for n in names],
    )


def dense_step(df: DataFrame, order_by: str, out: str = "step", slices: int = 1_024) -> DataFrame:
    """Number rows 1..N by a unique orderable column.

    Slice boundaries are approximate quantiles of the order column, so slices
    stay balanced whatever its distribution; at most ``slices`` boundaries
    reach the driver. Counts per slice give each slice its starting number.
    """
    key = F.col(order_by)
    dtype = dict(df.dtypes)[order_by]
    number = micros_of(key, dtype) if dtype.startswith("timestamp") else key
    points = _constant_array((i / slices for i in range(1, slices)), "double")
    bounds = df.select(F.percentile_approx(number, points, 10 * slices).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    sliced = _with_slice(df, number, bounds)
    counts = sliced.groupBy("_slice").agg(F.count("*").alias("n"))
    offsets = preceding_totals(counts, "_slice", ["n"])
    local = sliced.withColumn("_rn", F.row_number().over(Window.partitionBy("_slice").orderBy(key)))
    return local.join(offsets, "_slice").select(
        *[F.col(c) for c in df.columns], (F.col("_rn") + F.col("before_n")).cast("long").alias(out)
    )


def _constant_array(values, kind: str) -> Column:
    """A long constant array, parsed once by the optimizer from one string."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _with_slice(df: DataFrame, value: Column, bounds: list) -> DataFrame:
    """Add ``_slice``: how many of the sorted bounds are <= value.

    A binary search folded over the halving steps, so the expression stays
    small however many bounds there are.
    """
    if not bounds:
        return df.withColumn("_slice", F.lit(0).cast("long"))
    count = len(bounds)
    edges = _constant_array(bounds, "double" if isinstance(bounds[0], float) else "bigint")
    strides = F.array(*[F.lit(1 << i) for i in reversed(range(count.bit_length()))])

    def narrow(found: Column, stride: Column) -> Column:
        probe = found + stride
        reached = (probe <= count) & (F.element_at(edges, F.least(probe, F.lit(count))) <= value)
        return F.when(reached, probe).otherwise(found)

    return df.withColumn("_slice", F.aggregate(strides, F.lit(0), narrow).cast("long"))


def running_confusion(
    df: DataFrame,
    truth: str,
    positive: Column,
    false_alarm: Column,
    step: str = "step",
    block_rows: int = BLOCK_ROWS,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Confusion counts and rates after every step.

    ``positive`` marks detections of threats, ``false_alarm`` the benign rows
    that count as false positives (the two differ when monitored benign
    traffic is not an alarm).
    """
    y = F.col(truth)
    flags = {
        "tp": ((y == 1) & positive).cast("long"),
        "fp": ((y == 0) & false_alarm).cast("long"),
        "fn": ((y == 1) & ~positive).cast("long"),
        "tn": ((y == 0) & ~false_alarm).cast("long"),
    }
    series = running_sums(df, {**flags, **(extra or {})}, step, block_rows)
    rates = triage.running_rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    return series.select("*", *[e.alias(n) for n, e in rates.items()])


def load_phases(df: DataFrame, file: str, out: str = "analyst_load") -> DataFrame:
    """Analyst load by position of the row's file among all files, in name order.

    Rows without a file come last. ``file`` may also be a chunk index. Columns
    of the input keep their names, ``phase`` included.

    Only the list of distinct files is ordered; it is the table of input files
    and is joined without a hint, so its measured size decides the strategy.
    """
    files = df.select(file).distinct()
    ranked = files.select(
        F.col(file), (F.dense_rank().over(Window.orderBy(F.col(file).asc_nulls_last())) - 1).alias("_phase")
    )
    return null_safe_join(df, ranked, [file]).withColumn(out, phase_load(F.col("_phase"))).drop("_phase")
