"""Work per task follows the row count, not the layout of the files or the size of a group."""

import pytest
from pyspark.sql import functions as F

from flowtriage.operators import behaviour, models, sampling


def test_training_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 1_000)
    rows = spark.range(20_500).coalesce(1)  # one file, one row group
    sizes = models.in_even_tasks(rows).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 21 and max(r["count"] for r in sizes) <= 1_100


def test_a_fit_reads_no_more_rows_a_task_than_allowed(spark, monkeypatch):
    from pyspark.ml import Pipeline

    seen = []
    monkeypatch.setattr(models, "TASK_ROWS", 500)
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.extend(df.groupBy(F.spark_partition_id()).count().collect()))
    rows = spark.range(4_000).selectExpr("CAST(id % 2 AS INT) AS y", "CAST(id AS DOUBLE) AS x").coalesce(1)
    models.train_detector(rows, ["x"], "y")
    assert sum(r["count"] for r in seen) == 4_000 and max(r["count"] for r in seen) <= 600


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_sample_shuffles_no_rows_by_group(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = spark.range(5_000).withColumn("kind", F.concat(F.lit("threat"), (F.col("id") % 1).cast("string")))
        found = sampling.hash_sample(rows, ["kind"], "id", lambda n: F.lit(50))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert found.count() == 50
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@pytest.mark.parametrize("cap,timed,rows", [(1, True, 7), (4, True, 7), (9, False, 16), (30, True, 40), (200, True, 13)])
def test_chunks_of_many_runs_equal_each_run_alone(monkeypatch, cap, timed, rows):
    import random

    import pandas as pd

    rnd = random.Random(rows)
    runs, rank = [], 0
    for source in range(25):
        for run in range(rnd.choice([1, 1, 3])):
            n = rnd.choice([1, 2, 5, 60])
            us = sorted((rnd.choice([None, *range(0, 120_000_000, 900_000)]) for _ in range(n)), key=lambda u: (u is not None, u or 0))
            runs.append(pd.DataFrame({
                "_src": f"s{source}", "_run": run, "src_rank": range(rank, rank + n), "_old": False, "_halo": [i == 0 and run > 0 for i in range(n)],
                "_us": pd.array(us, dtype="Int64"), "_step": range(n),
                "port": pd.array([rnd.choice([None, 80, 443, 22]) for _ in range(n)], dtype="Int32"),
                "duration": [rnd.choice([float("nan"), 10.0, 999.0, 1e6 + 0.1]) for _ in range(n)],
                "size": [rnd.choice([float("nan"), 512.0, 0.1, 1480.25]) for _ in range(n)],
                "sent": [rnd.choice([float("nan"), 0.0, 20000.0]) for _ in range(n)],
            }))
            rank += n
    whole = pd.concat(runs, ignore_index=True)
    monkeypatch.setattr(behaviour, "CHUNK_ROWS", rows)
    parts = [whole.iloc[i : i + 5] for i in range(0, len(whole), 5)]
    got = pd.concat(list(behaviour.stream_measures(iter(parts), 60_000_000, cap, timed))).reset_index(drop=True)
    want = pd.concat([behaviour.window_measures(r, 60_000_000, cap, timed) for r in runs]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_exact=True)


def test_small_sources_share_a_pass(spark):
    import time

    rows = spark.range(40_000).selectExpr(
        "id AS flow_id", "id + 1 AS step", "timestamp_micros(id * 1500) AS ts", "CAST(id % 20000 AS STRING) AS src_ip",
        "CAST(id % 50 AS INT) AS dst_port", "CAST(id % 2000 AS DOUBLE) AS flow_duration",
        "CAST(id % 900 AS DOUBLE) AS pkt_size_avg", "CAST(id % 20000 AS DOUBLE) AS totlen_fwd_pkts",
    )
    started = time.time()
    assert behaviour.behaviour_features(rows).filter("beh_flow_count_window = 2").count() == 20_000
    assert time.time() - started < 30


def test_state_hands_on_each_flow_once():
    """Not a window of up to ``max_flows`` flows per flow."""
    import pandas as pd

    from flowtriage.streaming import behaviour_state

    class Buffer:
        flows = [(i, 80, 1.0, 1.0, 1.0) for i in range(50)]

        def exists(self):
            return True

        def get(self):
            return iter(self.flows)

        def put(self, flows):
            self.flows = flows

    state = behaviour_state.SourceWindow(50, None)
    state.buffer = Buffer()
    batch = pd.DataFrame({
        "flow_id": range(1_000), "us": range(100, 1_100), "dst_port": 80, "flow_duration": 1.0, "pkt_size_avg": 1.0,
        "totlen_fwd_pkts": 1.0, "control": None,
    })
    (handed,) = state.handleInputRows(("s",), iter([batch]), None)
    assert len(handed) == 1_050 and handed["_halo"].sum() == 50 and len(state.buffer.flows) == 50
    assert not any(isinstance(v, list) for v in handed.iloc[-1])


def test_windows_with_resets_need_no_second_ranking(spark):
    """Resets cut the runs of the one pass; large sources are split, small ones are whole."""
    from collections import defaultdict

    from tests.test_behaviour import SCHEMA, make_rows

    rows = make_rows(600, seed=44, ties=False)
    df = spark.createDataFrame(rows, SCHEMA)
    reset = (F.col("flow_id") % 37 == 5) | (F.col("src_ip") == "s1") & (F.col("flow_id") % 11 == 0)
    found = behaviour.behaviour_features(df, 10**6, 9, block_rows=12, reset=reset, keep=["flow_id"])
    assert found.columns[0] == "flow_id" and "src_ip" not in found.columns
    seen, want = defaultdict(int), {}
    for flow_id, _, _, source, *_ in rows:
        if flow_id % 37 == 5 or source == "s1" and flow_id % 11 == 0:
            seen[source] = 0
        else:
            seen[source] += 1
            want[flow_id] = float(min(9, seen[source]))
    assert {r["flow_id"]: r["beh_flow_count_window"] for r in found.collect()} == want


def test_a_reset_without_source_clears_its_port_key_only(spark, tmp_path):
    from flowtriage.streaming import jobs
    from tests.test_behaviour import BASE, SCHEMA

    def flows(first, ports):
        rows = [(first + i, first + i + 1, BASE.replace(second=first + i), None, p, 1.0, 1.0, 1.0) for i, p in enumerate(ports)]
        return spark.createDataFrame(rows, SCHEMA).withColumn("control", F.when(F.col("flow_id") == 2, "reset"))

    batches = jobs.BehaviourBatches(str(tmp_path), 3_600, 200)
    batches(flows(0, [80, 22, 80, 22, 80]), 0)
    batches(flows(5, [80, 22]), 1)
    found = spark.read.option("basePath", batches.results_folder).parquet(batches.results_folder)
    counts = {r["flow_id"]: r["beh_flow_count_window"] for r in found.collect()}
    assert counts == {0: 1.0, 1: 1.0, 3: 2.0, 4: 1.0, 5: 2.0, 6: 3.0}


def test_measured_flows_are_not_joined_back(spark):
    """Rows keep their columns on the way; only the offsets of large sources are joined."""
    from tests.test_behaviour import SCHEMA, make_rows

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.createDataFrame(make_rows(50, seed=45), SCHEMA)
        plan = behaviour.behaviour_features(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and "MapInArrow" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_tail_of_a_large_source_is_cut_before_the_shuffle(spark):
    from tests.test_behaviour import SCHEMA, make_rows

    rows = make_rows(400, seed=46)
    df = spark.createDataFrame(rows, SCHEMA)
    assert "WindowGroupLimit" in behaviour.behaviour_tail(df, 30)._jdf.queryExecution().executedPlan().toString()
    for cap in (30, 1_001):
        want = {r[0] for s in {r[3] for r in rows} for r in [x for x in rows if x[3] == s][-cap:]}
        got = behaviour.behaviour_tail(df.withColumn("ts", F.col("ts")), cap, block_rows=1).select("step").collect()
        assert {r["step"] - 1 for r in got} == want


def test_a_scored_table_reads_its_upload_for_the_scores_only(spark):
    """What follows reads the stored scores, without the features, and counts the steps there."""
    from flowtriage import schema as S
    from flowtriage.plans import composed

    scored = composed._scored(spark, "/root/testdata/sf0.001")
    files = scored.inputFiles()
    assert files and not [f for f in files if f.endswith(".csv")]
    assert not set(S.FEATURES) & set(scored.columns)
    assert {"step", "Label", "threat_score", "fused_score", "density_before", "action", "y", "detected"} <= set(scored.columns)


def test_positions_may_be_counted_on_another_table(spark):
    from flowtriage.operators import ordered

    rows = spark.range(500).selectExpr("id * 3 + 1 AS step", "CAST(id AS DOUBLE) AS score")
    found = ordered.row_positions(rows, "step", "at", 64, counted=rows.select("step"))
    assert found.filter("at != (step - 1) / 3 + 1").count() == 0 and found.count() == 500
