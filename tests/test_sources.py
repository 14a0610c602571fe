import json

import pytest
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.operators import metrics, models
from flowtriage.sources import readers, sinks


@pytest.fixture
def captures(spark, tmp_path):
    """Three dialects in two formats, with an ignored file among them."""
    folder = tmp_path / "captures"
    folder.mkdir()
    spark.createDataFrame([(80, 10.0, "Benign"), (22, float("inf"), "Bot")], "`Dst Port` int, `Flow Duration` double, Label string").coalesce(1).write.parquet(str(tmp_path / "a"))
    next((tmp_path / "a").glob("*.parquet")).rename(folder / "a.parquet")
    (folder / "b.csv").write_text("dst_port,duration,fwd_packets_count,src_ip,label\n443,5.5,7,10.0.0.1,DoS_Hulk\n53,oops,1,10.0.0.2,Benign\n")
    (folder / "c.csv").write_text(" Destination Port,Total Fwd Packets,Destination Port\n8080,3,1\n21,4,2\n")
    (folder / "d.csv").write_text("dst_port,duration,fwd_packets_count,src_ip,label\n22,1.0,2,10.0.0.9,Benign\n")
    (folder / "notes.txt").write_text("ignored")
    return str(folder)


def test_mixed_directory(spark, captures):
    df = readers.read_flows(spark, captures)
    rows = {(r["source_file"], int(r["Dst Port"])): r for r in df.collect()}
    # The infinite and the unparsable duration are dropped.
    assert set(rows) == {("a.parquet", 80), ("b.csv", 443), ("c.csv", 8080), ("c.csv", 21), ("d.csv", 22)}
    assert rows["b.csv", 443]["src_ip"] == "10.0.0.1" and rows["b.csv", 443]["Tot Fwd Pkts"] == 7.0
    assert rows["c.csv", 21]["Label"] == "Unknown" and rows["c.csv", 21]["coverage"] == 2
    assert df.columns[:62] == [*S.FEATURES, "Label"]


def test_lenient_read_keeps_rows(spark, captures):
    assert readers.read_flows(spark, captures, on_bad="zero").count() == 7


def test_allow_list_and_grouping(spark, captures):
    files = readers.list_files(spark, captures, allow=["B.csv", "d.csv"])
    assert [f.rsplit("/", 1)[-1] for f in files] == ["b.csv", "d.csv"]
    assert len(readers.group_by_header(spark, files)) == 1
    assert len(readers.group_by_header(spark, readers.list_files(spark, captures))) == 3
    assert readers.read_flows(spark, captures, allow=["d.csv"]).count() == 1
    assert readers.read_flows(spark, files=files, uniform=["?.csv"]).count() == 2


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.read_flows(spark, str(tmp_path))


def test_upload(spark, tmp_path):
    good, empty, broken = tmp_path / "g.csv", tmp_path / "e.csv", tmp_path / "b.csv"
    good.write_text(" Dst Port ,label\n80,Benign\n")
    empty.write_text("Dst Port,label\n")
    broken.write_text("Dst Port,label\nzzz,Benign\n")
    assert readers.read_upload(spark, str(good)).first()["Label"] == "Benign"
    for path in (empty, broken):
        with pytest.raises(ValueError):
            readers.read_upload(spark, str(path))


def test_soc_events(spark, tmp_path):
    path = tmp_path / "soc.csv"
    header = ",".join(S.SOC_EVENT_SCHEMA.names)
    path.write_text(header + "\n2024-01-01 10:00:00,2024-01-01,10,h,u,p,logon_failure,deny,x,high,3,SSH,OSS,1.1.1.1,2.2.2.2,0,1,t,a=1; country=CN,1\n")
    df, source = readers.read_soc_events(spark, str(path))
    row = df.first()
    assert source == "file" and row["timestamp"].hour == 10 and row["severity_num"] == 3
    with pytest.raises(FileNotFoundError):
        readers.read_soc_events(spark, str(tmp_path / "none.csv"))
    assert readers.read_soc_events(spark, str(tmp_path / "none.csv"), fallback=df)[1] == "fallback"


def test_state_document(spark, tmp_path):
    entry = {"step": 1, "threat_score": 0.5, "action": "Monitor", "true_label": 1, "reward": 35.0, "analyst_load": 0.3, "dst_port": 80, "flow_dur": 9}
    good, bad = tmp_path / "state.json", tmp_path / "bad.json"
    good.write_text(json.dumps({"events_captured": 1, "failed_requests": 0, "active_threats": 1, "flagged_ips": 1, "logs": [entry]}, indent=1))
    bad.write_text('{"events_captured": 1, "logs": [')
    document = readers.read_state(spark, str(good))
    assert document.first()["active_threats"] == 1
    assert readers.state_log(document).first().asDict() == entry
    assert readers.read_state(spark, str(bad)).count() == 0
    assert readers.read_state(spark, str(tmp_path / "missing.json")).count() == 0


def test_run_state_round_trip(spark, tmp_path):
    log = spark.createDataFrame(
        [(i + 1, 0.5, i % 3, i % 2, 1.0, 0.3, 80, 10) for i in range(30)],
        "step long, threat_score double, action int, true_label int, reward double, analyst_load double, dst_port int, flow_dur long",
    )
    path = str(tmp_path / "state")
    sinks.write_json(sinks.run_state(log), path)
    document = readers.read_state(spark, path)
    assert document.first()["events_captured"] == 30
    entries = readers.state_log(document).collect()
    assert [r["step"] for r in entries] == list(range(1, 31)) and entries[1]["action"] == "Monitor"


def test_scenario_documents(spark):
    df = spark.createDataFrame([("DoS attacks-Hulk", float(i)) for i in range(6)], "label string, a double")
    row = sinks.scenario_documents(metrics.label_medians(df, F.col("label"), ["a"])).first()
    assert row["scenario"] == "dos_attacks_hulk" and row["features"] == {"a": 2.5} and row["sample_count"] == 6


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert sinks.load_version(spark, folder) == (None, -1)
    for v in (0, 1, 2):
        sinks.save_version(spark.range(v + 1), folder, v)
    assert sinks.load_version(spark, folder)[0].count() == 3
    assert sinks.load_version(spark, folder, at_most=1)[1] == 1


def test_models_are_stored_and_refitted(spark, tmp_path):
    rows = [(float(i % 10), float(i % 3), int(i % 10 > 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    settings = models.DetectorSettings(rounds=2, depth=2)
    path, fits = str(tmp_path / "model"), []

    def fit():
        fits.append(1)
        return models.train_detector(df, ["a", "b"], "y", settings)

    first, loaded = sinks.load_detector(path, fit)
    assert not loaded and len(fits) == 1
    second, loaded = sinks.load_detector(path, fit)
    assert loaded and len(fits) == 1
    scored = models.score_flows(df, second)
    assert scored.filter("predicted = y").count() == 200
    top = models.feature_importance(spark, second, ["a", "b", "c"]).collect()
    assert top[0]["feature"] == "a" and all(r["importance"] > 0 for r in top)

    calibrator = models.fit_calibrator(scored, F.col("raw_score"), F.col("y"))
    sinks.save_model(calibrator, str(tmp_path / "cal"))
    again, loaded = sinks.load_calibrator(str(tmp_path / "cal"), lambda: None)
    assert loaded
    calibrated = models.calibrate(scored, again).agg(F.avg("calibrated"), F.avg("y")).first()
    assert calibrated[0] == pytest.approx(calibrated[1])
    assert models.calibrate(scored, None).filter("calibrated <> raw_score").count() == 0

    scaler_path = str(tmp_path / "scaler")
    scaler = sinks.load_scaler(spark, scaler_path, lambda: models.fit_scaler(df, ["a", "b"]))
    assert sinks.load_scaler(spark, scaler_path, lambda: None) == scaler


def test_routes_score_every_row_once(spark):
    rows = [(i, [80, 22, 9999][i % 3], float(i % 7), int(i % 7 > 3)) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, dst_port int, a double, y int")
    model = models.train_detector(df, ["a"], "y", models.DetectorSettings(rounds=1, depth=2))
    routed = df.withColumn("route", models.route([F.col("dst_port")]))
    scored = models.score_with_routes(routed, {"main": model, "web": model}, {})
    assert scored.count() == 210 and scored.select("id").distinct().count() == 210
    assert {r["route"] for r in scored.select("route").distinct().collect()} == {"web", "auth", "main"}


def test_a_declared_header_that_differs_fails(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text("dst_port,duration\n443,2000\n")
    (tmp_path / "part-2.csv").write_text("duration,dst_port\n2000,443\n")
    mapped = readers.read_flows(spark, str(tmp_path))
    assert {(int(r["Dst Port"]), r["Flow Duration"]) for r in mapped.collect()} == {(443, 2000.0)}
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_flows(spark, str(tmp_path), uniform=["part-*"]).collect()


def test_repeated_names_are_grouped_by_their_own_headers(spark, tmp_path):
    (tmp_path / "part-1.csv").write_text("dst_port,duration,dst_port\n443,2000,1\n")
    (tmp_path / "part-2.csv").write_text("duration,dst_port,dst_port\n2000,443,1\n")
    found = readers.read_flows(spark, str(tmp_path), uniform=["part-*"])
    assert {(int(r["Dst Port"]), r["Flow Duration"]) for r in found.collect()} == {(443, 2000.0)}


def test_versions_are_found_by_listing(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert sinks.load_version(spark, folder) == (None, -1)
    for n in (0, 2, 10):
        sinks.save_version(spark.range(n + 1), folder, n)
    (tmp_path / "v" / "version=11").mkdir()  # begun, never committed
    assert sinks.load_version(spark, folder)[1] == 10
    assert sinks.load_version(spark, folder, at_most=9)[1] == 2
    assert sinks.load_version(spark, folder, at_most=1)[0].count() == 1


def test_an_unreadable_model_is_not_replaced(spark, tmp_path):
    path = tmp_path / "model"
    path.mkdir()
    (path / "metadata").write_text("broken")
    with pytest.raises(Exception):
        sinks.load_calibrator(str(path), lambda: pytest.fail("must not fit"))
    assert (path / "metadata").read_text() == "broken"


def test_intermediate_tables_can_be_cleared(spark):
    from flowtriage.sources import workspace

    kept = workspace._MADE[:]
    workspace._MADE.clear()
    table = workspace.durable(spark.range(3))
    (path,) = workspace._MADE
    assert table.count() == 3 and workspace.exists(spark, path)
    assert workspace.clear(spark) == 1 and not workspace.exists(spark, path)
    workspace._MADE.extend(kept)
