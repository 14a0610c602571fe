"""Windows against a plain loop over a double-ended queue."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.operators import behaviour

BASE = datetime(2024, 1, 1)
SCHEMA = "flow_id long, step long, ts timestamp, src_ip string, dst_port int, flow_duration double, pkt_size_avg double, totlen_fwd_pkts double"


def make_rows(n, seed, ties=True):
    rng = random.Random(seed)
    rows, micros = [], 0
    for i in range(n):
        if not ties or rng.random() < 0.6:
            micros += rng.randrange(1, 3_000_000)
        # A third or more of all flows come from one source.
        source = "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}"
        rows.append((i, i + 1, BASE + timedelta(microseconds=micros), source, rng.choice([22, 80, 443, 53]),
                     rng.choice([100.0, 999.0, 1000.0, 5e4, 3e5]), rng.uniform(10, 900), rng.choice([5.0, 10_000.0, 10_001.0, 5e5])))
    return rows


def brute_force(rows, seconds, cap, arrival=False):
    buffers = defaultdict(lambda: deque(maxlen=cap))
    found = {}
    for flow_id, _, ts, source, port, duration, size, sent in rows:
        buffers[source].append((ts, port, duration, size, sent))
        window = [r for r in buffers[source] if arrival or ts - r[0] <= timedelta(seconds=seconds)]
        n = len(window)
        elapsed = 1.0 if arrival else max(1.0, (ts - window[0][0]).total_seconds())
        found[flow_id] = (
            n / elapsed * 60.0, sum(r[2] < 1000 for r in window) / n, float(len({r[1] for r in window})),
            float(np.std([r[3] for r in window])), float(n), sum(r[4] > 10_000 for r in window) / n,
            float(np.mean([r[2] for r in window])),
        )
    return found


def collect(df):
    return {r["flow_id"]: tuple(r[c] for c in S.BEHAVIOUR_COLUMNS) for r in df.collect()}


def assert_same(found, expected):
    assert found.keys() == expected.keys()
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, rel=1e-9, abs=1e-7), key


@pytest.mark.parametrize("seconds,cap,block_rows", [(60, 200, 64), (60, 10, 16), (20, 5, 7), (10_000, 200, 256)])
def test_window_equals_loop(spark, seconds, cap, block_rows):
    rows = make_rows(900, seed=seconds + cap)
    df = spark.createDataFrame(rows, SCHEMA)
    found = behaviour.behaviour_features(df, seconds, cap, block_rows=block_rows)
    assert_same(collect(found), brute_force(rows, seconds, cap))


def test_arrival_mode(spark):
    rows = make_rows(500, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    found = behaviour.behaviour_features(df, 60, 30, mode="arrival", block_rows=40)
    assert_same(collect(found), brute_force(rows, 60, 30, arrival=True))


def test_history_continues_a_run(spark):
    rows = make_rows(700, seed=9)
    expected = brute_force(rows, 60, 20)
    first, second = spark.createDataFrame(rows[:400], SCHEMA), spark.createDataFrame(rows[400:], SCHEMA)
    tail = behaviour.behaviour_tail(first, 20, block_rows=50)
    assert tail.groupBy("src_ip").count().agg(F.max("count")).first()[0] <= 20
    found = behaviour.behaviour_features(second, 60, 20, history=tail, block_rows=50)
    assert_same(collect(found), {k: v for k, v in expected.items() if k >= 400})


def test_score_bounds_and_vector(spark):
    rows = make_rows(200, seed=5)
    df = behaviour.behaviour_features(spark.createDataFrame(rows, SCHEMA))
    low, high = df.agg(F.min("behaviour_score"), F.max("behaviour_score")).first()
    assert 0.0 <= low <= high <= 1.0
    row = df.withColumn("v", behaviour.behaviour_vector()).first()
    assert len(row["v"]) == 7 and row["v"][4] == row["beh_flow_count_window"]


def test_reset_spells(spark):
    rows = make_rows(300, seed=8)
    df = spark.createDataFrame(rows, SCHEMA)
    found = behaviour.reset_spells(df, F.col("dst_port") == 53, block_rows=1)
    seen, expected = defaultdict(int), {}
    for r in rows:
        seen[r[3]] += r[4] == 53
        expected[r[0]] = seen[r[3]]
    assert {r["flow_id"]: r["spell"] for r in found.collect()} == expected


def test_single_shuffle_of_rows_per_window_stage(spark):
    df = spark.createDataFrame(make_rows(50, seed=1), SCHEMA)
    plan = behaviour.behaviour_features(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_zoneless_times_ignore_the_session_zone(spark):
    # Local times around a change to summer time, in a zone that has one.
    start = datetime(2024, 3, 10, 1, 59, 30, 250_001)
    rows = [(i, i + 1, start + timedelta(seconds=20 * i), "s", 80, 1.0, 1.0, 1.0) for i in range(10)]
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame(rows, SCHEMA.replace("ts timestamp", "ts timestamp_ntz"))
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        found = collect(behaviour.behaviour_features(df))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert_same(found, brute_force(rows, 60, 200))


def test_flows_without_a_source_are_keyed_by_port(spark):
    rows = [(*r[:3], None if i % 4 == 0 else r[3], *r[4:]) for i, r in enumerate(make_rows(400, seed=11))]
    found = behaviour.behaviour_features(spark.createDataFrame(rows, SCHEMA), 60, 20, block_rows=30)
    keyed = [(*r[:3], r[3] or f"row_{r[4]}", *r[4:]) for r in rows]
    assert_same(collect(found), brute_force(keyed, 60, 20))
    assert found.filter("src_ip IS NULL").count() == 100
    ranks = behaviour.with_source_rank(spark.createDataFrame(rows, SCHEMA), "src_ip", "step", 16)
    assert ranks.filter("src_ip IS NULL").agg(F.max("src_rank")).first()[0] == 100


def test_a_hot_source_costs_its_cap_per_flow(spark):
    import time

    rows = spark.range(40_000).selectExpr(
        "id AS flow_id", "id + 1 AS step", "timestamp_micros(id * 1500) AS ts", "'hot' AS src_ip",
        "CAST(id % 50 AS INT) AS dst_port", "CAST(id % 2000 AS DOUBLE) AS flow_duration",
        "CAST(id % 900 AS DOUBLE) AS pkt_size_avg", "CAST(id % 20000 AS DOUBLE) AS totlen_fwd_pkts",
    )
    started = time.time()
    assert behaviour.behaviour_features(rows).filter("beh_flow_count_window = 200").count() == 40_000 - 199
    assert time.time() - started < 60


def naive_measures(run, span_us, cap, timed):
    """Every window listed flow by flow."""
    import pandas as pd

    ordered = run.sort_values(["_us", "_step"], na_position="first", kind="stable").reset_index(drop=True)
    out = {}
    for i in range(len(ordered)):
        me = ordered.iloc[i]
        rows = ordered.iloc[max(0, i - cap + 1) : i + 1]
        if timed:
            mine = me["_us"]
            rows = rows.iloc[0:0] if mine is None or mine is pd.NA else rows[rows["_us"].notna() & (rows["_us"] >= mine - span_us)]
        n = len(rows)
        sizes = [x for x in rows["size"] if x == x]
        durations = [x for x in rows["duration"] if x == x]
        mean = sum(sizes) / len(sizes) if sizes else None
        elapsed = max(1.0, (rows["_us"].iloc[-1] - rows["_us"].iloc[0]) / 1e6) if timed and n else 1.0
        out[me["src_rank"]] = (
            n / elapsed * 60.0 if n else 0.0,
            sum(x < S.SHORT_FLOW_MICROS for x in rows["duration"]) / n if n else None,
            float(rows["port"].dropna().nunique()),
            (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5 if sizes else None,
            float(n),
            sum(x > S.LARGE_PAYLOAD_BYTES for x in rows["sent"]) / n if n else None,
            sum(durations) / len(durations) if durations else None,
        )
    return out


@pytest.mark.parametrize("cap,timed", [(1, True), (3, True), (7, False), (50, True), (200, True)])
def test_window_measures_equal_listed_windows(cap, timed):
    import pandas as pd

    rnd = random.Random(cap)
    n = 300
    us = [rnd.choice([None] + list(range(0, 120_000_000, 700_000))) for _ in range(n)]
    run = pd.DataFrame({
        "_src": "s", "src_rank": range(n), "_old": False, "_halo": [i < 5 for i in range(n)],
        "_us": pd.array([None if u is None else u for u in sorted(us, key=lambda u: (u is not None, u or 0))], dtype="Int64"),
        "_step": range(n),
        "port": pd.array([rnd.choice([None, 80, 443, 22, 53]) for _ in range(n)], dtype="Int32"),
        "duration": [rnd.choice([float("nan"), 10.0, 999.0, 5000.0, 1e6 + 0.1]) for _ in range(n)],
        "size": [rnd.choice([float("nan"), 512.0, 512.0, 0.1, 1480.25]) for _ in range(n)],
        "sent": [rnd.choice([float("nan"), 0.0, 20000.0]) for _ in range(n)],
    })
    got = behaviour.window_measures(run, 60_000_000, cap, timed)
    want = naive_measures(run, 60_000_000, cap, timed)
    assert len(got) == n - 5
    for row in got.itertuples(index=False):
        values = tuple(None if pd.isna(v) else float(v) for v in row[2:])
        for a, b in zip(values, want[row.src_rank]):
            assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12, abs=1e-12)


def test_equal_sizes_have_no_spread_at_all():
    import pandas as pd

    n = 500
    run = pd.DataFrame({
        "_src": "s", "src_rank": range(n), "_old": False, "_halo": False,
        "_us": pd.array(range(0, n * 1000, 1000), dtype="Int64"), "_step": range(n),
        "port": pd.array([80] * n, dtype="Int32"), "duration": 1.0, "sent": 1.0,
        "size": [1e9 + 0.3 if i < 250 else 0.7 for i in range(n)],
    })
    got = behaviour.window_measures(run, 10**12, 100, True)
    assert (got["beh_pkt_size_std"].iloc[99:240] == 0).all() and (got["beh_pkt_size_std"].iloc[350:] == 0).all()


def test_cost_per_flow_does_not_grow_with_the_cap(spark):
    import time

    rows = spark.range(40_000).selectExpr(
        "id AS flow_id", "id + 1 AS step", "timestamp_micros(id * 1500) AS ts", "'hot' AS src_ip",
        "CAST(id % 50 AS INT) AS dst_port", "CAST(id % 2000 AS DOUBLE) AS flow_duration",
        "CAST(id % 900 AS DOUBLE) AS pkt_size_avg", "CAST(id % 20000 AS DOUBLE) AS totlen_fwd_pkts",
    )
    started = time.time()
    found = behaviour.behaviour_features(rows, window_seconds=10**6, max_flows=20_000)
    assert found.filter("beh_flow_count_window = 20000").count() == 40_000 - 19_999
    assert time.time() - started < 60


def test_stored_sketches_unite_like_one_sketch(spark):
    rows = spark.range(30_000).selectExpr("CAST(id % 7 AS INT) AS chunk", "CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(id % 9000 AS STRING) END AS src_ip")
    stored = behaviour.source_sketches(rows, ["chunk"])
    united = behaviour.united_sources(stored).first()
    whole = behaviour.united_sources(behaviour.source_sketches(rows.withColumn("chunk", F.lit(0)), ["chunk"])).first()
    assert united.sketches == 7 and united.sources == whole.sources
    assert abs(united.sources - 9000) <= behaviour.relative_error_bound() * 9000
    by_half = behaviour.united_sources(stored.withColumn("half", F.col("chunk") % 2), ["half"]).collect()
    assert len(by_half) == 2 and all(r.sources <= united.sources for r in by_half)
