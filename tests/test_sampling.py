import hashlib
import random

import pytest
from pyspark.sql import functions as F

from flowtriage.operators import sampling


def shuffle_key(row_id, seed=42):
    return hashlib.md5(f"{row_id}:{seed}".encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(0)
    data = [(i, "big" if rng.random() < 0.6 else f"c{rng.randrange(4)}", rng.randrange(2)) for i in range(3_000)]
    return spark.createDataFrame(data, "id long, chunk string, y int").repartition(5).cache()


def test_first_per_group_with_a_hot_group(rows):
    found = sampling.first_per_group(rows, ["chunk"], [F.col("id")], 50, "id").collect()
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r["id"]):
        expected.setdefault(r["chunk"], []).append(r["id"])
    assert sorted((r["chunk"], r["rn"], r["id"]) for r in found) == sorted(
        (c, i + 1, v) for c, ids in expected.items() for i, v in enumerate(ids[:50])
    )


@pytest.mark.parametrize("fraction", [0.1, 0.5, 0.0001])
def test_holdout_has_the_exact_size_and_members(rows, fraction):
    found = {r["id"] for r in sampling.holdout_split(rows, "id", fraction).filter("is_eval").collect()}
    ordered = sorted(range(3_000), key=shuffle_key)
    assert found == set(ordered[: max(1, int(3_000 * fraction))])


def test_calibration_sample_sizes(rows):
    counts = {r["chunk"]: r["count"] for r in rows.groupBy("chunk").count().collect()}
    found = {r["chunk"]: r["count"] for r in sampling.calibration_sample(rows, "chunk", "id", cap=60).groupBy("chunk").count().collect()}
    assert found == {c: min(n // 20, 60) for c, n in counts.items() if min(n // 20, 60)}


def test_file_split(spark):
    for n, train in ((1, 1), (2, 1), (5, 4), (29, 23)):
        df = spark.createDataFrame([(f"f{i:02d}",) for i in range(n)], ["file"])
        split = {r["file"]: r["is_train"] for r in sampling.split_files(df, "file").collect()}
        assert [split[f] for f in sorted(split)] == [i < train for i in range(n)]


def sequential_augmentation(chunks, look_ahead):
    """Batches as (sorted ids, borrowed chunk and class) by walking the chunks."""
    seeds, batches, pending = {}, [], []

    def note(name, members):
        for y in {m[1] for m in members}:
            seeds[y] = name

    if look_ahead:
        for name, members in chunks[:2]:
            note(name, members)
    for name, members in chunks:
        own, note_members = pending + members, pending + members
        pending = []
        note(name, note_members)
        classes = {m[1] for m in own}
        if len(classes) == 1:
            other = 1 - next(iter(classes))
            if other not in seeds:
                pending = own
                continue
            batches.append((name, sorted(m[0] for m in own), (seeds[other], other)))
        else:
            batches.append((name, sorted(m[0] for m in own), None))
    return batches


@pytest.mark.parametrize("look_ahead", [0, 1])
@pytest.mark.parametrize("kinds", ["bbam", "mbbaa", "bmab", "bbbb", "abmba", "m", "babab"])
def test_single_class_augmentation(spark, kinds, look_ahead):
    chunks, next_id = [], 0
    for i, kind in enumerate(kinds):
        ys = {"b": [0] * 3, "a": [1] * 3, "m": [0, 1, 1]}[kind]
        chunks.append((i, [(next_id + j, y) for j, y in enumerate(ys)]))
        next_id += 3
    df = spark.createDataFrame([(i, n, y) for i, ms in chunks for n, y in ms], "chunk int, id long, y int")
    found = sampling.augment_single_class(df, "chunk", "y", "id", look_ahead=look_ahead).collect()
    expected = sequential_augmentation(chunks, look_ahead)
    assert sorted({r["batch"] for r in found}) == [b for b, *_ in expected]
    for batch, own, borrowed in expected:
        assert sorted(r["id"] for r in found if r["batch"] == batch and not r["is_seed"]) == own
        seeds = {(r["chunk"], r["y"]) for r in found if r["batch"] == batch and r["is_seed"]}
        assert seeds == ({borrowed} if borrowed else set())


def test_ratio_sample_clamps(rows):
    few = rows.filter((F.col("y") == 0) | (F.col("id") < 100))
    attacks = few.filter("y = 1").count()
    picked = sampling.ratio_sample(few, F.col("y"), "id", 1_000, 0.5)
    assert picked.filter("y = 1").count() == attacks and picked.filter("y = 0").count() == 500


@pytest.mark.parametrize("count", [5, 40])
def test_round_robin(spark, count):
    sizes = {"PortScan": 2, "Bot": 30, "DoS": 5}
    data = [(i, name) for i, name in enumerate(n for n, k in sizes.items() for _ in range(k))]
    found = sampling.round_robin(spark.createDataFrame(data, "id long, label string"), "label", "id", count).orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(1, min(count, 37) + 1))
    assert len({r["id"] for r in found}) == len(found)
    if count >= 10:
        assert found[0]["label"] == "PortScan"
    taken = [r["label"] for r in found]
    assert abs(taken[:6].count("Bot") - taken[:6].count("DoS")) <= 1


def test_result_page(rows):
    page = sampling.result_page(rows, "id", 500).collect()
    assert len(page) == 500 and page[0]["total_rows"] == 3_000 and page[0]["rows_truncated"]
    small = sampling.result_page(rows.filter("id < 10"), "id", 500).first()
    assert small["total_rows"] == 10 and not small["rows_truncated"]


def test_representative_log_small_pool(spark):
    data = [(i + 1, 1 if i % 5 == 0 else 0, [0, 1, 2][i % 3]) for i in range(60)]
    df = spark.createDataFrame(data, "step long, true_label int, action int")
    found = sampling.representative_log(df).collect()
    threats = sum(t for _, t, _ in data)
    monitored = min(15, sum(t == 0 and a == 1 for _, t, a in data))
    escalated = min(10, sum(t == 0 and a == 2 for _, t, a in data))
    dismissed = sum(t == 0 and a == 0 for _, t, a in data)
    assert len(found) == threats + monitored + escalated + dismissed
    assert [r["step"] for r in found] == sorted(r["step"] for r in found)


def test_preferred_source(spark):
    data = [(1, "bot", "botnet_ares.csv"), (2, "Bot", "other.csv"), (3, "SQL Injection", "other.csv"), (4, "Benign", "x.csv")]
    df = spark.createDataFrame(data, "id long, label string, file string")
    # The preferred file of SQL Injection is not part of the input, so its row stays.
    assert sorted(r["id"] for r in sampling.preferred_source_filter(df, "label", "file").collect()) == [1, 3, 4]


def test_rows_without_a_key_are_kept(spark):
    rows = [(i, None if i % 4 == 0 else i % 4, i % 2, None if i % 10 == 0 else f"f{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, chunk int, y int, file string")
    assert sampling.with_split(df, "file").count() == 200
    assert sampling.calibration_sample(df, "chunk", "id", divisor=5).filter("chunk IS NULL").count() == 10
    assert sampling.holdout_split(df.withColumn("id", F.when(F.col("id") > 3, F.col("id"))), "id").count() == 200
    made = sampling.augment_single_class(df, "chunk", "y", "id", rows=3)
    assert made.filter("NOT is_seed").count() == 200 and set(made.columns) == {*df.columns, "batch", "is_seed"}
