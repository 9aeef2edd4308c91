"""Boundary tests for the silver classes, flags and time parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensortwin.functions import classify_energy, classify_moisture
from sensortwin.operators.layers import to_bronze, to_silver

from twin_rows import make_raw, ts


@pytest.mark.parametrize("value,expected", [
    (None, None), (2.49, "OUT_OF_SPEC"), (2.5, "MARGINAL"), (2.99, "MARGINAL"), (3.0, "IN_SPEC"),
    (4.0, "IN_SPEC"), (5.0, "IN_SPEC"), (5.01, "MARGINAL"), (5.5, "MARGINAL"), (5.51, "OUT_OF_SPEC"),
])
def test_moisture_classes(spark, value, expected):
    df = spark.createDataFrame([(value,)], "m double")
    assert df.select(classify_moisture("m")).first()[0] == expected


@pytest.mark.parametrize("value,expected", [
    (None, None), (0.0, "LOW"), (49.99, "LOW"), (50.0, "MEDIUM"), (200.0, "MEDIUM"), (200.01, "HIGH"),
])
def test_energy_classes(spark, value, expected):
    df = spark.createDataFrame([(value,)], "e double")
    assert df.select(classify_energy("e")).first()[0] == expected


def test_silver_derivations_and_null_guard(spark):
    raw = make_raw(spark, [
        {"event_ts": ts("2024-01-01T23:59:59.999999"), "event_type": "alarm", "moisture_pct": 5.0},
        {"event_ts": ts("2024-01-02T00:00:00"), "event_type": "batch_end"},
        {"event_id": None},
        {"event_ts": None},
        {"event_type": "quality_check", "energy_kwh": 50.0},
    ])
    rows = {r["event_id"]: r for r in to_silver(to_bronze(raw)).collect()}
    assert set(rows) == {"e0", "e1", "e4"}  # NULL id / NULL ts dropped
    a = rows["e0"]
    assert str(a["event_date"]) == "2024-01-01" and a["event_hour"] == 23
    assert a["event_hour_ts"].hour == 23 and a["event_hour_ts"].minute == 0
    assert a["event_minute_ts"].minute == 59 and a["event_minute_ts"].second == 0
    assert a["is_alarm"] and not a["is_quality_check"] and not a["is_batch_lifecycle"]
    assert a["moisture_quality"] == "IN_SPEC"
    assert rows["e1"]["is_batch_lifecycle"] and str(rows["e1"]["event_date"]) == "2024-01-02"
    assert rows["e4"]["is_quality_check"] and rows["e4"]["energy_intensity"] == "MEDIUM"


def test_bronze_parses_iso_text_and_nulls_bad_values(spark):
    df = spark.createDataFrame(
        [("1", "2026-03-01T06:00:00.123456+00:00", "12.5"), ("2", "not a time", "abc")],
        "event_id string, event_ts string, temperature_c string")
    for c in ("event_type", "equipment_id", "equipment_name", "equipment_type", "line_id", "plant_id",
              "batch_id", "alarm_code", "alarm_severity", "cip_phase"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    from sensortwin.schemas import EVENT_SCHEMA
    for f in EVENT_SCHEMA.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    b = {r["event_id"]: r for r in to_bronze(df).collect()}
    assert b["1"]["event_ts"].microsecond == 123456 and b["1"]["temperature_c"] == 12.5
    assert b["2"]["event_ts"] is None and b["2"]["temperature_c"] is None
