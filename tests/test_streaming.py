"""Streams over several micro-batches agree with the batch operators."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import triage
from flowtriage.operators import behaviour, ordered, policy
from flowtriage.sources import sinks
from flowtriage.streaming import behaviour_state, jobs
from tests.test_behaviour import SCHEMA, assert_same, brute_force, collect, make_rows
from tests.test_policy import FLOW, make_flows


def feed(spark, handler, frames, tmp_path):
    """Hand each table to a foreachBatch job as one micro-batch, via files."""
    inbox = tmp_path / "inbox"
    inbox.mkdir(exist_ok=True)
    progress = str(tmp_path / "progress")
    for i, frame in enumerate(frames):
        staging = tmp_path / f"stage{i}"
        frame.coalesce(1).write.parquet(str(staging))
        next(staging.glob("*.parquet")).rename(inbox / f"{i}.parquet")
        jobs.run_batches(jobs.file_stream(spark, str(inbox), frames[0].schema), handler, checkpoint=progress)


def test_stateful_processor_equals_loop(spark, tmp_path):
    rows = make_rows(400, seed=12, ties=False)
    inbox = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(inbox))
    stream = behaviour_state.stream_behaviour(jobs.file_stream(spark, str(inbox), spark.read.parquet(str(inbox)).schema), 60, 20)
    assert_same(collect(jobs.run_to_table(stream)), brute_force(rows, 60, 20))


def test_stateful_reset(spark, tmp_path):
    rows = make_rows(150, seed=13, ties=False)
    inbox = tmp_path / "in"
    df = spark.createDataFrame(rows, SCHEMA).withColumn("control", F.when(F.col("flow_id") == 80, "reset"))
    df.coalesce(1).write.parquet(str(inbox))
    source = rows[80][3]
    stream = behaviour_state.stream_behaviour(jobs.file_stream(spark, str(inbox), df.schema), 100_000, 200)
    counts = {r["flow_id"]: r["beh_flow_count_window"] for r in jobs.run_to_table(stream).collect()}
    after = [r[0] for r in rows if r[3] == source and r[0] > 80]
    assert [counts[i] for i in after] == [float(k + 1) for k in range(len(after))]


def test_behaviour_batches_continue(spark, tmp_path):
    rows = make_rows(600, seed=21)
    batches = jobs.BehaviourBatches(str(tmp_path / "work"), 60, 20, block_rows=30)
    frames = [spark.createDataFrame(rows[i : i + 200], SCHEMA) for i in (0, 200, 400)]
    feed(spark, batches, frames, tmp_path)
    found = spark.read.option("basePath", batches.results_folder).parquet(batches.results_folder)
    assert_same(collect(found), brute_force(rows, 60, 20))


def test_behaviour_batches_reset(spark, tmp_path):
    rows = make_rows(300, seed=22, ties=False)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("control", F.when(F.col("flow_id") == 140, "reset"))
    batches = jobs.BehaviourBatches(str(tmp_path / "work"), 100_000, 200, block_rows=30)
    feed(spark, batches, [df.filter("flow_id < 120"), df.filter("flow_id between 120 and 199"), df.filter("flow_id >= 200")], tmp_path)
    found = spark.read.option("basePath", batches.results_folder).parquet(batches.results_folder)
    counts = {r["flow_id"]: r["beh_flow_count_window"] for r in found.collect()}
    source = rows[140][3]
    after = [r[0] for r in rows if r[3] == source and r[0] > 140]
    assert [counts[i] for i in after] == [float(k + 1) for k in range(len(after))]
    assert 140 not in counts


def test_online_learner_freezes_policy_inside_a_batch(spark, tmp_path):
    rows = make_flows(500, seed=30)
    frames = [spark.createDataFrame(rows[a:b], FLOW) for a, b in ((0, 200), (200, 500))]
    learner = jobs.OnlineLearner(str(tmp_path / "work"))
    feed(spark, learner, frames, tmp_path)
    # The same in batch: decide with the stored policy, then fold, batch by batch.
    dense = ordered.threat_density(spark.createDataFrame(rows, FLOW), "threat_score")
    known = policy.empty_policy(spark)
    for number, condition in enumerate(("step <= 200", "step > 200")):
        decided = policy.decide(dense.filter(condition), known, "threat_score", F.col("analyst_load"))
        stored = spark.read.parquet(f"{learner.decisions_folder}/version={number}")
        assert {r["step"]: r["action"] for r in stored.collect()} == {r["step"]: r["action"] for r in decided.collect()}
        rewarded = decided.withColumn("reward", triage.reward(F.col("y"), F.col("action"), F.col("analyst_load"), F.col("threat_score")))
        after = triage.state_columns(F.col("threat_score"), F.col("analyst_load"), F.col("density_after"), F.col("dst_port"))
        known = policy.fold_updates(rewarded.withColumns(after), known)
        loaded, usable = sinks.load_policy(spark, learner.policy_folder, at_most=number + 1)
        assert usable
        expected = {tuple(r[c] for c in policy.CELL): (r["visits"], r["q"]) for r in known.collect()}
        found = {tuple(r[c] for c in policy.CELL): (r["visits"], r["q"]) for r in loaded.collect()}
        assert found.keys() == expected.keys()
        for cell, (visits, value) in expected.items():
            assert found[cell][0] == visits and found[cell][1] == pytest.approx(value)
    # Repeating a batch rewrites the same version and nothing else.
    learner(frames[1], 1)
    assert {r["step"] for r in spark.read.parquet(f"{learner.decisions_folder}/version=1").collect()} == set(range(201, 501))
    assert sinks.load_version(spark, learner.policy_folder)[1] == 2


def test_progress_continues_over_batches(spark, tmp_path):
    rows = [(i + 1, i % 2, (i * 7) % 3, float(i % 5)) for i in range(1_000)]
    schema = "step long, y int, action int, reward double"
    writer = jobs.ProgressWriter(str(tmp_path / "work"), every=100, block_rows=64)
    feed(spark, writer, [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 350), (350, 1_000))], tmp_path)
    shots = spark.read.option("basePath", f"{writer.root}/snapshots").parquet(f"{writer.root}/snapshots").orderBy("step").collect()
    assert [r["step"] for r in shots] == list(range(100, 1_001, 100))
    for r in shots:
        done = rows[: r["step"]]
        assert r["tp"] == sum(y == 1 and a >= 1 for _, y, a, _ in done)
        assert r["fp"] == sum(y == 0 and a == 2 for _, y, a, _ in done)
        assert r["cumulative_reward"] == sum(x for *_, x in done)


def test_triage_is_the_same_on_tables_and_streams(spark, tmp_path):
    rows = [(i, [80, 22, 53][i % 3], round((i * 37 % 100) / 100, 2), ["Benign", "Bot", None][i % 3 - 1]) for i in range(200)]
    df = spark.createDataFrame(rows, "flow_id long, dst_port int, threat_score double, label string")
    inbox = tmp_path / "in"
    df.write.parquet(str(inbox))
    stream = jobs.triage_flows(jobs.file_stream(spark, str(inbox), df.schema))
    found = sorted(map(tuple, jobs.run_to_table(stream).collect()), key=str)
    assert found == sorted(map(tuple, jobs.triage_flows(df).collect()), key=str)
    header = jobs.stream_header(jobs.triage_flows(df)).first()
    assert header["total"] == 200 and header["n_attacks"] + header["n_benign"] == 200


def test_dead_letters(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None), (4, "NaN"), (5, "1e3")], "id int, v string")
    usable, broken = jobs.split_valid(df, ["v"])
    assert [r["id"] for r in usable.collect()] == [1, 5] and [r["id"] for r in broken.collect()] == [2, 3, 4]


def test_parts_with_restarts_and_a_hand_over(spark):
    from flowtriage.streaming import restore

    rows = make_rows(600, seed=31, ties=False)
    df = spark.createDataFrame(rows, SCHEMA)
    found, first, second = restore.behaviour_over_parts(df, lambda raw: raw, "step", parts=4, hand_over=2, window_seconds=60, max_flows=20)
    assert (first.batches, second.batches) == (2, 2)
    assert_same(collect(found), brute_force(rows, 60, 20))
    tail = restore.last_state(spark, first, second)
    want = behaviour.behaviour_tail(df, 20).select("src_ip", "flow_duration").collect()
    got = tail.select(F.col("src_key").alias("src_ip"), F.col("duration").alias("flow_duration")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_parts_of_an_empty_table(spark):
    from flowtriage.streaming import restore

    empty = spark.createDataFrame([], SCHEMA)
    found, first, second = restore.behaviour_over_parts(empty, lambda raw: raw, "step", window_seconds=60, max_flows=20)
    assert found.count() == 0 and restore.last_state(spark, first, second).count() == 0


def test_dead_letters_one_write_per_batch_and_retries(spark, tmp_path):
    letters = jobs.DeadLetters(str(tmp_path / "letters"), ["raw"])
    schema = "flow_id long, raw string"
    first = spark.createDataFrame([(1, "3"), (2, "n/a"), (3, None)], schema)
    second = spark.createDataFrame([(4, "NaN"), (5, "7.5")], schema)
    empty_good, empty_bad = letters.read(spark, first.schema)
    assert empty_good.count() == 0 and empty_bad.count() == 0
    letters(first, 0)
    letters(first, 0)  # a retried batch rewrites its own folder
    letters(second, 1)
    good, bad = letters.read(spark, first.schema)
    assert sorted(r.flow_id for r in good.collect()) == [1, 5]
    assert sorted(r.flow_id for r in bad.collect()) == [2, 3, 4]
