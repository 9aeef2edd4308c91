"""Sources and small serving options: CSV dimensions (UTF-8), namespace, point lookup,
optional time filter, live tail stream, landing writer format."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from sensortwin.operators import serving
from sensortwin.operators.gold import equipment_metrics, sustainability_hourly
from sensortwin.operators.layers import to_bronze, to_silver
from sensortwin.session import local_path, scratch_path
from sensortwin.schemas import EQUIPMENT_SCHEMA, RAW_MATERIAL_BATCH_SCHEMA
from sensortwin.sources import (batches_reference, create_namespace, load_reference, peek, read_batches_csv,
                                read_equipment_csv, row_count, to_landing_json, with_ingest_metadata)
from sensortwin.streaming.pipeline import live_tail, new_paths, run_available, silver_stream

from twin_rows import make_raw, ts

EQUIPMENT_CSV = """equipment_id,name,type,line_id,plant_id,capacity_kg_h,commissioned_year
EQ-A,Dryer Ä,spray_dryer,LINE-A,PLANT-ÉTOILE,12000,2018
EQ-F,Flow meter,flow_meter,LINE-B,PLANT-ÅSBERG,,2019
"""
BATCHES_CSV = """batch_id,plant_id,milk_origin,product_type,protein_pct,fat_pct,lactose_pct,moisture_pct,viscosity_cp,volume_liters,received_at,supplier_id,quality_grade
B-2,PLANT-ÅSBERG,Øster Ñ,infant,34.0,27.5,35.2,3.7,950,35000,2026-03-01T07:00:00Z,SUP-1,A+
B-1,PLANT-ÉTOILE,Vallée Ä,infant,32.1,26.4,38.2,4.1,850,45000,2026-03-01T06:00:00Z,SUP-2,A
"""


def _write(spark, name, text):
    d = local_path(scratch_path(spark, name))
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, f"{name}.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


def test_reference_csvs_utf8_and_types(spark):
    eq = read_equipment_csv(spark, _write(spark, "equipment", EQUIPMENT_CSV))
    assert eq.schema == EQUIPMENT_SCHEMA
    rows = {r["equipment_id"]: r for r in eq.collect()}
    assert rows["EQ-A"]["plant_id"] == "PLANT-ÉTOILE" and rows["EQ-A"]["name"] == "Dryer Ä"
    assert rows["EQ-F"]["capacity_kg_h"] is None and rows["EQ-A"]["capacity_kg_h"] == 12000
    ref = serving.equipment_reference(eq).collect()
    assert [r["equipment_id"] for r in ref] == ["EQ-F", "EQ-A"]  # PLANT-ÅSBERG sorts first
    assert "install_year" in ref[0].asDict()

    b = read_batches_csv(spark, _write(spark, "batches", BATCHES_CSV))
    assert b.schema == RAW_MATERIAL_BATCH_SCHEMA
    listing = batches_reference(b).collect()
    assert [r["batch_id"] for r in listing] == ["B-1", "B-2"]
    assert listing[0]["received_at"].hour == 6 and listing[1]["viscosity_cp"] == 950


def test_load_reference_replaces_table(spark):
    create_namespace(spark, "twin_test")
    path = _write(spark, "equipment2", EQUIPMENT_CSV)
    assert load_reference(spark, path, EQUIPMENT_SCHEMA, "twin_test.equipment").count() == 2
    t2 = load_reference(spark, path, EQUIPMENT_SCHEMA, "twin_test.equipment")  # replaced, not appended
    assert t2.count() == 2
    assert peek(t2, 1).count() == 1 and row_count(t2).first()["row_count"] == 2


def test_point_lookup_and_optional_filter(spark):
    raw = make_raw(spark, [
        {"equipment_id": "EQ-1", "event_ts": ts("2024-01-01T10:00:00"), "temperature_c": 1.0},
        {"equipment_id": "EQ-1", "event_ts": ts("2024-01-01T08:00:00"), "temperature_c": 2.0},
        {"equipment_id": "EQ-2", "event_ts": ts("2024-01-01T10:00:00"), "temperature_c": 3.0},
    ])
    s = to_silver(to_bronze(raw))
    g = equipment_metrics(s, computed_at=False)
    h = serving.equipment_history(g, "EQ-1", hours=1, as_of=ts("2024-01-01T10:30:00")).collect()
    assert [r["avg_temperature_c"] for r in h] == [1.0]
    h24 = serving.equipment_history(g, "EQ-1", hours=24, as_of=ts("2024-01-01T10:30:00")).collect()
    assert [r["avg_temperature_c"] for r in h24] == [2.0, 1.0]
    sus = sustainability_hourly(s, computed_at=False)
    assert serving.sustainability(sus, as_of=ts("2024-01-01T10:30:00"), hours=1).count() == 1
    assert serving.sustainability(sus, as_of=ts("2024-01-01T10:30:00"), hours=0).count() == 2


def test_metadata_on_non_file_frame_is_null(spark):
    df = with_ingest_metadata(make_raw(spark, [{}]), now="2024-01-01 00:00:00")
    r = df.first()
    assert r["_source_file"] is None and r["_ingested_at"] is not None


def test_landing_json_timestamp_text(spark):
    raw = make_raw(spark, [{"event_ts": ts("2024-01-01T00:00:07.179575")}])
    text = to_landing_json(raw.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))).first()["event_ts"]
    assert text == "2024-01-01T00:00:07.179575+00:00"


def test_live_tail_stream(spark):
    from sensortwin.sources.events import replay_to_landing
    paths = new_paths(spark, "tail")
    replay_to_landing(make_raw(spark, [{"temperature_c": 1.0}, {"temperature_c": 2.0}]), paths.landing, files=1)
    run_available(spark, paths)
    q = (live_tail(silver_stream(spark, paths.bronze)).writeStream.format("memory").queryName("tail_test")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.table("tail_test").collect()
    assert sorted(r["temperature_c"] for r in rows) == [1.0, 2.0] and "flow_rate_lph" in rows[0].asDict()


def test_pipeline_cli_available_now(spark):
    from sensortwin.plans.inputs import Inputs
    from sensortwin.sources.events import replay_to_landing
    from sensortwin.streaming.__main__ import main
    from sensortwin.streaming.pipeline import TwinPaths, read_gold

    root = scratch_path(spark, "cli")
    landing = scratch_path(spark, "cli-landing")
    replay_to_landing(Inputs(spark, "/root/testdata/sf0.001").raw, landing, files=2)
    main(["--root", root, "--landing", landing, "--available-now"])
    gold = read_gold(spark, TwinPaths(root, landing))
    assert gold["equipment_metrics"].count() > 0 and gold["batch_yield"].count() > 0


def test_landing_text_round_trips_in_any_session_zone(spark):
    """An instant written in a non-UTC session zone parses back to the same instant."""
    raw = make_raw(spark, [{"event_ts": ts("2024-01-01T00:00:07.179575")}])
    before = raw.select(F.unix_micros("event_ts")).first()[0]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
        text = to_landing_json(raw).first()["event_ts"]
        assert text.endswith("+01:00")
        back = spark.createDataFrame([(text,)], "t string").select(F.unix_micros(F.col("t").cast("timestamp")))
        assert back.first()[0] == before
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_point_lookup_takes_any_id_literally(spark):
    raw = make_raw(spark, [{"equipment_id": "EQ-'1; DROP", "event_ts": ts("2024-01-01T10:00:00"), "temperature_c": 7.0}])
    g = equipment_metrics(to_silver(to_bronze(raw)), computed_at=False)
    h = serving.equipment_history(g, "EQ-'1; DROP", hours=1, as_of=ts("2024-01-01T10:30:00")).collect()
    assert [r["avg_temperature_c"] for r in h] == [7.0]
