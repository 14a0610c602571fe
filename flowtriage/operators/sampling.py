"""Reproducible samples, stratified quotas, top-k and file splits.

Random order is the md5 of row id and seed, so a sample depends on the data
only, not on partitioning, and a lost task recomputes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowtriage import schema as S
from flowtriage.functions.flow import binary_label, hash_order, literal_map
from flowtriage.operators.ordered import BLOCK_ROWS, block_of, null_safe_join, preceding_totals

SALTS = 256
HASH_BUCKET_DIGITS = 4  # 16^4 = 65,536 buckets


def first_per_group(df: DataFrame, keys: list[str], order: list, limit: int, salt: str, rank: str = "rn") -> DataFrame:
    """The first ``limit`` rows of every group, numbered in ``rank``.

    Each group is first cut down inside 256 salted shares, so a group holding a
    large part of the table is spread over 256 tasks and at most
    ``256 * limit`` of its rows meet in one.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    in_share = Window.partitionBy(*keys, "_salt").orderBy(*order)
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn(rank, F.row_number().over(in_share))
        .filter(F.col(rank) <= limit)
        .withColumn(rank, F.row_number().over(in_group))
        .filter(F.col(rank) <= limit)
        .drop("_salt")
    )


def hash_sample(
    df: DataFrame, keys: list[str], row_id: str, quota, seed: int | str | Column = 42, rank: str = "rn"
) -> DataFrame:
    """``quota`` random rows of every group, numbered in ``rank``.

    ``quota`` maps the group's row count (a column) to the number wanted. The
    count also tells below which hash value that many rows must lie, with a
    margin of twelve standard deviations; rows above it are dropped in the
    scan, so only little more than the sample is shuffled and ranked, however
    large a group is. Should the margin ever not suffice, the query fails
    rather than return a short sample.

    Groups are files, chunks, classes or labels: their limits (a row per group)
    are broadcast, since a join shuffled by group would bring a whole class to
    one task before a row is dropped.
    """
    n, wanted = F.col("_n"), F.col("_quota").cast("double")
    reach = F.least(F.lit(1.0), (wanted + 12 * F.sqrt(wanted) + 200) / n)
    cut = F.lower(F.lpad(F.hex(F.floor(reach * (16**8 - 1)).cast("long")), 8, "0"))
    limits = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_quota", F.least(quota(n), n).cast("long"))
        .withColumn("_cut", cut)
        .drop("_n")
    )
    group = Window.partitionBy(*keys)
    ranked = (
        null_safe_join(df.withColumn("_hash", hash_order(F.col(row_id), seed)), F.broadcast(limits), keys)
        .filter(F.substring("_hash", 1, 8) <= F.col("_cut"))
        .withColumn(rank, F.row_number().over(group.orderBy("_hash")))
        .withColumn("_got", F.count("*").over(group))
    )
    short = F.raise_error(F.lit("sample margin exceeded")).cast("boolean")
    return ranked.filter(F.when(F.col("_got") < F.col("_quota"), short).otherwise(F.col(rank) <= F.col("_quota"))).drop(
        "_hash", "_quota", "_cut", "_got"
    )


def cap_per_file(df: DataFrame, file: str, row_order: str, rows: int) -> DataFrame:
    """The first ``rows`` rows of every file."""
    return first_per_group(df, [file], [F.col(row_order)], rows, row_order).drop("rn")


def split_files(df: DataFrame, file: str, train_ratio: float = 0.8) -> DataFrame:
    """Mark files as train or test: the first 80 % by name train, at least one."""
    # The list of input files is short; both windows run over it only.
    files = df.select(file).distinct()
    train = F.greatest(
        F.lit(1), F.floor(F.count("*").over(Window.partitionBy(F.lit(0))) * F.lit(train_ratio)).cast("int")
    )
    rank = F.dense_rank().over(Window.orderBy(file))
    return files.select(file, (rank <= train).alias("is_train"))


def with_split(df: DataFrame, file: str, train_ratio: float = 0.8) -> DataFrame:
    return null_safe_join(df, split_files(df, file, train_ratio), [file])


def calibration_sample(
    df: DataFrame, chunk: str, row_id: str, divisor: int = 20, cap: int = 10_000, seed: int = 42
) -> DataFrame:
    """min(n div 20, cap) random rows of every chunk of n rows."""
    share = lambda n: F.least(F.floor(n / divisor), F.lit(cap))
    return hash_sample(df, [chunk], row_id, share, seed).drop("rn")


def class_seeds(
    df: DataFrame, chunk: str, truth: str, row_id: str, rows: int = 2_048, seed: int = 42
) -> DataFrame:
    """Up to ``rows`` random rows per class and chunk (candidate reference rows)."""
    return hash_sample(df, [chunk, truth], row_id, lambda n: F.lit(rows), seed).drop("rn")


def newest_class_seeds(
    df: DataFrame, chunk: str, truth: str, row_id: str, rows: int = 2_048, seed: int = 42
) -> DataFrame:
    """Per class, the seed rows of the newest chunk holding that class."""
    newest = df.groupBy(truth).agg(F.max(chunk).alias(chunk))
    of_newest = null_safe_join(df, newest, [truth, chunk], "left_semi")
    return class_seeds(of_newest, chunk, truth, row_id, rows, seed)


def augment_single_class(
    df: DataFrame,
    chunk: str,
    truth: str,
    row_id: str,
    rows: int = 2_048,
    seed: int = 42,
    look_ahead: int = 0,
) -> DataFrame:
    """Training batches in which both classes occur.

    Batches are chunks in order. Leading chunks seen before the second class
    appears wait and merge into the first chunk that completes the pair; a
    later single-class chunk borrows the other class's seed rows from the
    latest chunk at or before it. ``look_ahead`` = 1 lets the first chunk
    borrow from its successor, as a reader that buffers two chunks does.
    Adds ``batch`` and ``is_seed``; if only one class exists, nothing trains.
    Rows without a chunk are a chunk of their own, before all others.
    """
    # Chunks go by their place in the order, which is never null.
    stats = df.groupBy(chunk).agg(F.min(truth).alias("lo"), F.max(truth).alias("hi"))
    # The list of chunks is the list of input files or file parts.
    ordered = Window.orderBy(chunk)
    numbered = stats.withColumn("pos", F.row_number().over(ordered))
    ordered, so_far = Window.orderBy("pos"), Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plan = numbered.select(
        chunk,
        "lo",
        "hi",
        "pos",
        F.max(F.when(F.col("lo") == 0, F.col("pos"))).over(so_far).alias("seen_0"),
        F.max(F.when(F.col("hi") == 1, F.col("pos"))).over(so_far).alias("seen_1"),
        F.lead("lo").over(ordered).alias("next_lo"),
        F.lead("hi").over(ordered).alias("next_hi"),
        F.lead("pos").over(ordered).alias("next_chunk"),
    )
    if look_ahead:
        first = F.col("pos") == 1
        plan = plan.withColumn(
            "seen_0", F.when(first & (F.col("next_lo") == 0), F.coalesce("seen_0", "next_chunk")).otherwise(F.col("seen_0"))
        ).withColumn(
            "seen_1", F.when(first & (F.col("next_hi") == 1), F.coalesce("seen_1", "next_chunk")).otherwise(F.col("seen_1"))
        )
    ready = F.col("seen_0").isNotNull() & F.col("seen_1").isNotNull()
    plan = plan.withColumn(
        "_batch",
        F.when(ready, F.col("pos")).otherwise(
            F.min(F.when(ready, F.col("pos"))).over(ordered.rowsBetween(0, Window.unboundedFollowing))
        ),
    ).filter(F.col("_batch").isNotNull())
    named = plan.select(F.col(chunk).alias("batch"), F.col("pos").alias("_batch"))
    placed = null_safe_join(df, plan.select(chunk, F.col("pos").alias("_pos"), "_batch"), [chunk])
    own_rows = placed.withColumn("is_seed", F.lit(False))
    # A merged batch holds both classes already, so only single-class batches borrow.
    needs = (
        plan.groupBy("_batch")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("seen_0", "pos").alias("seen_0"),
             F.max_by("seen_1", "pos").alias("seen_1"))
        .filter(F.col("lo") == F.col("hi"))
        .select(
            "_batch",
            (1 - F.col("lo")).alias(truth),
            F.when(F.col("lo") == 1, F.col("seen_0")).otherwise(F.col("seen_1")).alias("_pos"),
        )
    )
    lenders = placed.drop("_batch").join(needs.select("_pos", truth).distinct(), ["_pos", truth], "left_semi")
    borrowed = (
        class_seeds(lenders, "_pos", truth, row_id, rows, seed)
        .join(needs, ["_pos", truth])
        .withColumn("is_seed", F.lit(True))
    )
    return own_rows.unionByName(borrowed).join(named, "_batch").drop("_batch", "_pos")


def ratio_sample(
    df: DataFrame, truth: Column, row_id: str, n_rows: int, attack_ratio: float, seed: int = 42
) -> DataFrame:
    """``n_rows`` rows with the requested share of attacks, in random order.

    Each class gives at most what it has. ``order_key`` is the shuffle.
    """
    attacks = max(0, round(n_rows * attack_ratio))
    quota = F.when(F.col("_class") == 1, attacks).otherwise(n_rows - attacks)
    picked = hash_sample(df.withColumn("_class", truth), ["_class"], row_id, lambda n: quota, seed)
    return picked.withColumn("order_key", hash_order(F.col(row_id), seed)).drop("rn", "_class")


def round_robin(
    df: DataFrame, label: str, row_id: str, n_rows: int, seed: int = 42, hard_labels=S.HARD_LABELS
) -> DataFrame:
    """One row per label and round until ``n_rows`` are taken.

    With ten or more rows asked for, the first slot is reserved for a label
    known to be hard to detect, when the data has one. ``position`` numbers
    the picks.
    """
    order = hash_order(F.col(row_id), seed)
    ranked = hash_sample(df, [label], row_id, lambda n: F.lit(n_rows), seed)
    ranked = ranked.withColumn("_order", order)
    turn = F.col("rn")
    if n_rows >= 10 and hard_labels:
        # The reserved row is the first hard row by shuffle order; its label
        # starts its own rounds with the next row.
        hard = F.col(label).isin(*hard_labels) & (F.col("rn") == 1)
        reserved = (
            ranked.filter(hard).agg(F.min(F.struct("_order", label)).alias("r")).select(f"r.{label}").scalar()
        )
        turn = turn - F.coalesce((F.col(label) == reserved).cast("int"), F.lit(0))
    chosen = ranked.withColumn("_turn", turn).orderBy("_turn", label).limit(n_rows)
    return chosen.withColumn(
        "position", F.row_number().over(Window.orderBy("_turn", label)).cast("long")
    ).drop("rn", "_order", "_turn")


def holdout_split(df: DataFrame, row_id: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Mark exactly ``max(1, floor(n * fraction))`` random rows as ``is_eval``.

    Rows are bucketed by the leading hash digits (65,536 buckets). Whole
    buckets fall on one side; only the bucket at the boundary is ranked, so no
    ordered pass sees more than one bucket's rows.
    """
    order = hash_order(F.col(row_id), seed)
    keyed = df.withColumn("_hash", order).withColumn("_bucket", F.substring("_hash", 1, HASH_BUCKET_DIGITS))
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("n"))
    # At most 65,536 rows: one per hash prefix.
    cumulative = counts.select(
        "_bucket",
        "n",
        F.coalesce(
            F.sum("n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"),
    )
    wanted = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(fraction))).cast("long")
    plan = cumulative.select("_bucket", (wanted - F.col("before")).alias("room"), "n")
    marked = keyed.join(F.broadcast(plan), "_bucket")
    boundary = (F.col("room") > 0) & (F.col("room") < F.col("n"))
    rest = marked.filter(~boundary).withColumn("is_eval", F.col("room") >= F.col("n"))
    edge = marked.filter(boundary).withColumn(
        "is_eval", F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash")) <= F.col("room")
    )
    return rest.unionByName(edge).drop("_hash", "_bucket", "room", "n")


def representative_log(
    log: DataFrame, n: int = 100, step: str = "step", truth: str = "true_label", action: str = "action"
) -> DataFrame:
    """A balanced excerpt of a decision log, in step order.

    Up to n/2 threats, 10 escalated and 15 monitored benign rows, all random;
    the rest are dismissed benign rows taken at even spacing.
    """
    y, a = F.col(truth), F.col(action)
    stratum = (
        F.when(y == 1, "threat").when(a == 2, "escalated").when(a == 1, "monitored").otherwise("dismissed")
    )
    named = log.withColumn("_stratum", stratum)
    caps = {"threat": n // 2, "escalated": 10, "monitored": 15}
    name = F.col("_stratum")
    cap = F.when(name == "threat", caps["threat"]).when(name == "escalated", caps["escalated"]).otherwise(caps["monitored"])
    seed = F.when(name == "threat", "42").when(name == "escalated", "43").otherwise("44")
    random_part = hash_sample(
        named.filter(name != "dismissed"), ["_stratum"], step, lambda rows: cap, seed
    ).drop("rn")
    taken = F.lit(0)
    for kind, limit in caps.items():
        taken = taken + F.least(F.count_if(name == kind), F.lit(limit))
    # Both numbers come from one aggregation.
    sizes = named.agg(
        F.struct((n - taken).alias("room"), F.count_if(F.col("_stratum") == "dismissed").alias("pool")).alias("s")
    ).scalar()
    spaced = _every_kth(named.filter(F.col("_stratum") == "dismissed"), step, sizes["room"], sizes["pool"])
    return random_part.unionByName(spaced).drop("_stratum").orderBy(step).limit(n)


def _every_kth(rows: DataFrame, step: str, room: Column, pool: Column) -> DataFrame:
    """``room`` of ``pool`` rows at stride max(1, pool div room), counted in step order."""
    stride = F.greatest(F.lit(1), F.floor(pool / F.greatest(F.lit(1), room))).cast("long")
    blocked = rows.withColumn("_blk", block_of(F.col(step), BLOCK_ROWS))
    offsets = preceding_totals(blocked.groupBy("_blk").agg(F.count("*").alias("n")), "_blk", ["n"])
    position = F.row_number().over(Window.partitionBy("_blk").orderBy(step)) - 1
    return (
        blocked.withColumn("_pos", position)
        .join(offsets, "_blk")
        .withColumn("_pos", F.col("_pos") + F.col("before_n"))
        .filter((F.col("_pos") % stride == 0) & (F.floor(F.col("_pos") / stride) < room))
        .drop("_blk", "_pos", "before_n")
    )


def top_labels(df: DataFrame, label: Column, limit: int = 10, minimum: int = 5) -> DataFrame:
    """The most frequent labels, ties by name, at least ``minimum`` rows each."""
    return (
        df.groupBy(label.alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "label")
        .limit(limit)
        .filter(F.col("n") >= minimum)
    )


def preferred_source_filter(df: DataFrame, label: str, file: str) -> DataFrame:
    """Drop rows of a label that has a preferred file, unless they come from it.

    A preference only counts when that file is part of the input.
    """
    preferred = F.try_element_at(literal_map(S.PREFERRED_SOURCES), F.lower(F.trim(F.col(label))))
    available = (
        df.select(F.lower(F.col(file)).alias("_pref"))
        .filter(F.col("_pref").isin(*S.PREFERRED_SOURCES.values()))
        .distinct()
        .withColumn("_available", F.lit(True))
    )
    # At most one row per preferred file name.
    return (
        df.withColumn("_pref", preferred)
        .join(F.broadcast(available), "_pref", "left")
        .filter(F.col("_available").isNull() | (F.lower(F.col(file)) == F.col("_pref")))
        .drop("_pref", "_available")
    )


def result_page(df: DataFrame, order: str, limit: int = 500) -> DataFrame:
    """First ``limit`` result rows plus the total and whether rows were cut."""
    total = df.agg(F.count("*").alias("n")).scalar()
    return (
        df.orderBy(order)
        .limit(limit)
        .withColumn("total_rows", total)
        .withColumn("rows_truncated", F.col("total_rows") > limit)
    )


def specialist_subset(df: DataFrame, port: str, ports, chunk: str, minimum: int = 20) -> DataFrame:
    """Rows on the given ports, from chunks that hold at least ``minimum`` of them."""
    subset = df.filter(F.col(port).isin(*ports))
    enough = subset.groupBy(chunk).agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)
    return subset.join(enough.select(chunk), chunk, "left_semi")


def with_truth(df: DataFrame, label: str = "label", out: str = "y") -> DataFrame:
    return df.withColumn(out, binary_label(F.col(label)))
