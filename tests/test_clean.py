import math

import pytest
from pyspark.sql import functions as F

from flowtriage import schema as S
from flowtriage.functions import flow
from flowtriage.operators import clean


def test_fixed_tables_have_their_sizes():
    assert len(S.FEATURES) == len(set(S.FEATURES)) == 61
    assert len(S.SCENARIO_FEATURES) == 24
    assert len(S.LONG_NAME_ALIASES) == 41 and len(S.SNAKE_CASE_ALIASES) == 59
    assert len(S.LABEL_FAMILIES) == 20 and len(set(S.LABEL_FAMILIES.values())) == 12
    assert set(S.SCENARIO_FEATURES) <= set(S.FEATURES)


def test_headers_first_column_wins_before_and_after_aliases():
    names = clean.normalise_headers([" Dst Port ", "DST PORT", "dst_port", "Destination Port", "duration", "Label"])
    assert names == ["dst port", None, None, None, "flow duration", "label"]


def test_duplicate_headers_in_a_table(spark):
    raw = spark.createDataFrame([(1, 2, 3, "Benign")], ["a", "b", "c", "d"]).toDF("Dst Port", "dst port", "dst_port", "Label")
    row = clean.canonicalise(raw).first()
    assert row["Dst Port"] == 1.0 and row["Label"] == "Benign"


def test_missing_features_and_label(spark):
    row = clean.canonicalise(spark.createDataFrame([(80,)], [" Destination Port"])).first()
    assert row["Dst Port"] == 80.0 and row["Idle Min"] == 0.0 and row["Label"] == "Unknown"
    assert len(row) == 62


def test_underscore_spelling_resolves(spark):
    row = clean.canonicalise(spark.createDataFrame([(7.0,)], ["Fwd_Seg_Size_Min"])).first()
    assert row["Fwd Seg Size Min"] == 7.0


def test_bad_rows_are_dropped_or_zeroed(spark):
    rows = [(1, 1.0, "Benign"), (2, math.inf, "Benign"), (3, -math.inf, "x"), (4, math.nan, "x"), (5, None, "x"), (6, 2.0, None)]
    raw = spark.createDataFrame(rows, "id int, `Flow Duration` double, label string")
    assert [r["id"] for r in clean.canonicalise(raw, keep={"id": "id"}).collect()] == [1]
    zeroed = {r["id"]: r["Flow Duration"] for r in clean.canonicalise(raw, on_bad="zero", keep={"id": "id"}).collect()}
    assert zeroed == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 2.0}


def test_fallbacks_are_inert_unless_asked_for(spark):
    raw = spark.createDataFrame([(9, 4)], ["fwd_packets_count", "fwd_payload_bytes_min"])
    plain, filled = clean.canonicalise(raw).first(), clean.canonicalise(raw, fallbacks=True).first()
    assert plain["Fwd Act Data Pkts"] == 0.0 and plain["Tot Fwd Pkts"] == 9.0
    assert filled["Fwd Act Data Pkts"] == 9.0 and filled["Fwd Seg Size Min"] == 4.0


def test_units_and_transport(spark):
    raw = spark.createDataFrame([("10.0.0.1", "x", 2.0)], ["Src IP", "Src Port", "duration"])
    row = clean.canonicalise(raw, units={"Flow Duration": 1e6}, transport=True).first()
    assert row["Flow Duration"] == 2e6 and row["src_ip"] == "10.0.0.1" and row["src_port"] is None


def test_coverage_counts():
    assert clean.feature_coverage(S.FEATURES) == 61
    assert clean.feature_coverage(S.SNAKE_CASE_ALIASES) == 59
    assert clean.feature_coverage(S.SNAKE_CASE_ALIASES, fallbacks=True) == 61
    assert clean.feature_coverage(["nothing"]) == 0


@pytest.mark.parametrize("text,value", [("1.5", 1.5), ("abc", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0), (" 3 ", 3.0)])
def test_lenient_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(flow.lenient_double(F.col("t"))).first()[0] == value


def test_soc_message(spark):
    df = spark.createDataFrame([("bytes_out=5; country=CN; service=BSS",)], ["msg"])
    assert df.select(flow.soc_message_field(F.col("msg"), "country")).first()[0] == "CN"


def test_source_key(spark):
    df = spark.createDataFrame([("1.2.3.4", 80), (None, 80)], "ip string, port int")
    keys = [r[0] for r in df.select(flow.source_key(F.col("ip"), F.col("port"))).collect()]
    assert keys == ["1.2.3.4", "row_80"]
    assert df.select(flow.source_key(None, F.col("port"), "flow_")).first()[0] == "flow_80"
