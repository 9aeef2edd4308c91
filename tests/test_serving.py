"""Serving, graph, what-if and alarm rules: defaults, quirks and every branch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensortwin import config as C
from sensortwin.operators import alarms, graph, serving, whatif
from sensortwin.operators.gold import equipment_metrics
from sensortwin.operators.layers import to_bronze, to_silver
from sensortwin.schemas import SCENARIO_SCHEMA

from twin_rows import make_raw, ts

BATCH_COLS = ("batch_id string, plant_id string, avg_viscosity_cp double, avg_protein_pct double, "
              "avg_fat_pct double, total_energy_kwh double, ftr_rate_pct double, alarm_count long")


def _batches(spark, rows):
    return spark.createDataFrame(rows, BATCH_COLS)


def _scenarios(spark, rows):
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def test_what_if_defaults_treat_zero_as_missing(spark):
    b = _batches(spark, [("B", "P", 0.0, None, 0.0, None, 0.0, 0)])
    r = whatif.what_if(_scenarios(spark, [("B", None, None, None)]), b).first()
    assert r["base_viscosity_cp"] == C.DEFAULT_VISCOSITY and r["base_fat_pct"] == C.DEFAULT_FAT
    assert r["base_protein_pct"] == C.DEFAULT_PROTEIN and r["base_ftr_rate_pct"] == C.DEFAULT_FTR
    assert r["base_energy_kwh"] == 0.0 and r["delta_energy_pct"] == 0.0
    assert r["heat_setting_c"] == 72.0 and r["recommendation"] == C.RECOMMENDATIONS[4]


@pytest.mark.parametrize("energy,fat,prot,heat,expected", [
    (0.5, 0.0, -1.0, 72.0, 0),      # energy -10.8 %, quality 75 -> optimal
    (1.0, 1.0, 0.0, 95.0, 1),       # energy +45.6 % -> caution
    (10000.0, 1.0, 0.0, 80.0, 2),   # quality 83.3, energy flat -> quality improved
    (10000.0, -1.0, 0.0, 62.0, 3),  # quality 65.5 -> degraded
    (10000.0, 0.0, 0.0, 72.0, 4),   # nothing changes -> minor
])
def test_recommendation_branches(spark, energy, fat, prot, heat, expected):
    b = _batches(spark, [("B", "P", 800.0, 30.0, 25.0, energy, 90.0, 2)])
    r = whatif.what_if(_scenarios(spark, [("B", fat, prot, heat)]), b).first()
    assert r["recommendation"] == C.RECOMMENDATIONS[expected]


def test_what_if_formula_values(spark):
    b = _batches(spark, [("B", "P", 800.0, 30.0, 25.0, 100.0, 90.0, 4)])
    r = whatif.what_if(_scenarios(spark, [("B", 0.5, 0.2, 90.0)]), b).first()
    vol = max(4 * 0.5, 1.0)
    ed = 0.5 * 0.042 * vol + (0.2 * 1.8 * 10) * 0.003 * vol + 18 * 0.018 * vol
    assert r["sim_viscosity_cp"] == round(800 + 3.6, 1)
    assert abs(r["delta_energy_kwh"] - round(ed, 2)) < 1e-9
    # 75 + 10.8 + 1.75 = 87.55: SQL round is half-up on the decimal value (87.6); Python's
    # round on the binary double would give 87.5 -- the documented rounding choice.
    assert r["sim_quality_score"] == 87.6
    assert r["sim_fat_pct"] == 25.5 and r["sim_protein_pct"] == 30.2


def test_validation_and_unknown_batches(spark):
    s = _scenarios(spark, [("B", 1.5, 0.0, 72.0), ("B", 0.0, 0.0, 96.0), (None, 0.0, 0.0, 72.0),
                           ("B", None, None, None), ("ZZ", 0.0, 0.0, 72.0)])
    ok, bad = whatif.validate_scenarios(s)
    assert ok.count() == 2 and bad.count() == 3
    reasons = sorted(r["reason"] for r in bad.collect())
    assert reasons == ["batch_id required", "fat_delta_pct out of range", "heat_setting_c out of range"]
    b = _batches(spark, [("B", "P", 1.0, 1.0, 1.0, 1.0, 1.0, 1)])
    assert [r["batch_id"] for r in whatif.unknown_batches(ok, b).collect()] == ["ZZ"]


def test_scenario_grid_size(spark):
    b = _batches(spark, [("B", "P", 1.0, 1.0, 1.0, 1.0, 1.0, 1)])
    g = whatif.scenario_grid(b)
    assert g.count() == 21 * 21 * 3
    assert sorted({r["heat_setting_c"] for r in g.collect()}) == [63.0, 72.0, 90.0]


def test_batch_status_quirk(spark):
    df = spark.createDataFrame([(0.0,), (None,), (89.9,), (90.0,)], "c double")
    got = [r[0] for r in df.select(graph.batch_status(F.col("c"))).collect()]
    assert got == ["ok", "ok", "warning", "ok"]


def test_machine_status(spark):
    df = spark.createDataFrame([(1, 20.0), (0, 85.1), (0, 85.0), (None, None)], "a int, t double")
    got = [r[0] for r in df.select(serving.machine_status(F.col("a"), F.col("t"))).collect()]
    assert got == ["alarm", "warning", "ok", "ok"]


def test_event_status_badge(spark):
    df = spark.createDataFrame([("X", "IN_SPEC"), (None, "MARGINAL"), (None, None), (None, "IN_SPEC")],
                               "alarm_code string, moisture_quality string")
    assert [r[0] for r in df.select(serving.event_status()).collect()] == ["X", "OOB", "OK", "OK"]


def test_detect_alarms_rules(spark):
    raw = make_raw(spark, [
        {"equipment_type": "spray_dryer", "moisture_pct": 5.6},
        {"equipment_type": "spray_dryer", "moisture_pct": 2.9},
        {"equipment_type": "spray_dryer", "moisture_pct": 5.0},
        {"equipment_type": "mixer", "viscosity_cp": 1050.5},
        {"equipment_type": "cip_unit", "water_liters": 4500.0},
        {"equipment_type": "cip_unit", "water_liters": 4500.5},
        {"equipment_type": "spray_dryer", "moisture_pct": 6.0, "event_type": "quality_check"},
    ])
    rows = {r["event_id"]: r for r in alarms.detect_alarms(raw).collect()}
    assert (rows["e0"]["alarm_code"], rows["e0"]["alarm_severity"]) == ("MOISTURE_OUT_OF_SPEC", "HIGH")
    assert rows["e1"]["alarm_severity"] == "MEDIUM" and rows["e1"]["event_type"] == "alarm"
    assert not rows["e2"]["rule_fired"] and rows["e2"]["event_type"] == "sensor_reading"
    assert rows["e3"]["alarm_code"] == "VISCOSITY_OUT_OF_RANGE"
    assert not rows["e4"]["rule_fired"] and rows["e5"]["alarm_code"] == "WATER_OVERCONSUMPTION"
    assert not rows["e6"]["rule_fired"]


def test_alerts_and_history(spark):
    raw = make_raw(spark, [
        {"event_type": "alarm", "event_ts": ts("2024-01-01T00:01:00")},
        {"event_type": "alarm", "event_ts": ts("2024-01-01T00:11:00")},
        {"event_type": "alarm", "event_ts": ts("2024-01-01T00:12:00")},
        {"event_type": "alarm", "event_ts": ts("2024-01-01T00:13:00")},
        {"equipment_id": "EQ-2", "event_ts": ts("2024-01-01T00:14:00")},
    ])
    g = equipment_metrics(to_silver(to_bronze(raw)), computed_at=False)
    latest = alarms.alerts(g).collect()
    assert len(latest) == 1 and latest[0]["severity"] == "critical" and latest[0]["alarm_count"] == 3
    first = alarms.alert_history(g).collect()
    assert len(first) == 1 and first[0]["window_5min"].minute == 0 and first[0]["severity"] == "warning"


def test_dashboard_kpis_on_empty_inputs(spark):
    raw = make_raw(spark, [{"event_type": "batch_start"}])
    s = to_silver(to_bronze(raw))
    from sensortwin.operators.gold import batch_yield
    r = serving.dashboard_kpis(equipment_metrics(s, computed_at=False), batch_yield(s, computed_at=False)).first()
    assert r["total_alarms"] == 0 and r["avg_temperature_c"] == 0.0 and r["avg_ftr_rate_pct"] == 0.0
    assert r["ftr_trend"] == "down" and r["alarms_trend"] is None


def test_carbon_traceback_zero_average(spark):
    gb = spark.createDataFrame(
        [("B1", "P", ["L"], 1.0, 1.0, 1.0, None, 1.0, ts("2024-01-01T00:00:00"), 1.0, 1.0, 3),
         ("B2", "P", ["L"], 1.0, 1.0, 1.0, 0.0, 1.0, ts("2024-01-02T00:00:00"), 1.0, 1.0, 3)],
        "batch_id string, plant_id string, line_ids array<string>, avg_protein_pct double, avg_fat_pct double, "
        "avg_viscosity_cp double, total_energy_kwh double, ftr_rate_pct double, batch_first_seen timestamp, "
        "avg_moisture_pct double, moisture_compliance_pct double, total_events long")
    tb = serving.carbon_traceback(gb).collect()
    assert [r["co2_vs_avg_pct"] for r in tb] == [0.0, 0.0]
    assert [r["severity"] for r in tb] == ["ok", "ok"]
    ins = serving.carbon_insight(serving.carbon_traceback(gb)).first()
    assert ins["gap_pct"] == 0.0 and ins["worst_batch_id"] == "B2" and ins["best_batch_id"] == "B1"


def test_plant_energy_share_floor(spark):
    s = spark.createDataFrame([("P1", 0.5), ("P2", 0.25)], "plant_id string, total_energy_kwh double")
    got = {r["plant_id"]: r["energy_share_pct"] for r in serving.plant_energy_share(s).collect()}
    assert got == {"P1": 50.0, "P2": 25.0}


def test_alarm_impact_joins_alarm_machines_to_their_batches(spark):
    from sensortwin.operators.graph import NODE_COLUMNS
    cols = ", ".join(f"{c} {'double' if c.startswith(('avg_', 'total_', 'ftr_', 'moisture_')) else 'int' if c == 'alarm_count' else 'string'}"
                     for c in NODE_COLUMNS)
    nodes = spark.createDataFrame([
        ("B1", "batch", "B1", None, "P1", "L", None, None, None, 4.0, 31.0, 25.0, 96.0, 92.0, "ok"),
        ("B1", "batch", "B1", None, "P2", "L", None, None, None, 4.1, 32.0, 26.0, 97.0, 88.0, "warning"),
        ("B2", "batch", "B2", None, "P1", "L", None, None, None, 4.2, 33.0, 27.0, 98.0, 99.0, "ok"),
        ("EQ-1", "equipment", "M1", "mixer", "P1", "L", 70.0, 5.0, 2, None, None, None, None, None, "alarm"),
        ("EQ-2", "equipment", "M2", "mixer", "P1", "L", 90.0, 5.0, 0, None, None, None, None, None, "warning"),
    ], cols)
    edges = spark.createDataFrame([("B1->EQ-1", "B1", "EQ-1", "processed_by", 5, "M1", "mixer"),
                                   ("B2->EQ-2", "B2", "EQ-2", "processed_by", 3, "M2", "mixer"),
                                   ("B9->EQ-1", "B9", "EQ-1", "processed_by", 1, "M1", "mixer")],
                                  "id string, source string, target string, label string, event_count long, "
                                  "equipment_name string, equipment_type string")
    rows = sorted((r["batch_id"], r["batch_plant_id"], r["equipment_id"], r["event_count"])
                  for r in graph.alarm_impact(nodes, edges).collect())
    # only the alarm machine EQ-1; its batch B1 is listed in two plants; B9 is not a node
    assert rows == [("B1", "P1", "EQ-1", 5), ("B1", "P2", "EQ-1", 5)]


def test_requests_may_omit_optional_fields(spark):
    b = _batches(spark, [("B", "P", 800.0, 30.0, 25.0, 100.0, 90.0, 2)])
    only_ids = spark.createDataFrame([("B",)], "batch_id string")
    r = whatif.what_if(only_ids, b).first()
    assert (r["fat_delta_pct"], r["protein_delta_pct"], r["heat_setting_c"]) == (0.0, 0.0, 72.0)
    assert r["recommendation"] == C.RECOMMENDATIONS[4]


def test_one_baseline_per_batch_option(spark):
    b = _batches(spark, [("B", "P2", 800.0, 30.0, 25.0, 100.0, 90.0, 2),
                         ("B", "P1", 700.0, 31.0, 26.0, 50.0, 95.0, 1)])
    req = _scenarios(spark, [("B", 0.0, 0.0, 80.0)])
    assert whatif.what_if(req, b).count() == 2                      # every plant's row
    rows = whatif.what_if(req, b, one_per_batch=True).collect()    # one, the smallest plant id
    assert len(rows) == 1 and rows[0]["plant_id"] == "P1" and rows[0]["base_viscosity_cp"] == 700.0


def test_renamed_machine_fans_out_like_the_application(spark):
    raw = make_raw(spark, [
        {"equipment_id": "EQ-1", "equipment_name": "Old", "event_ts": ts("2024-01-01T00:01:00"), "temperature_c": 1.0},
        {"equipment_id": "EQ-1", "equipment_name": "New", "event_ts": ts("2024-01-01T00:02:00"), "temperature_c": 2.0},
    ])
    g = equipment_metrics(to_silver(to_bronze(raw)), computed_at=False)
    registry = spark.createDataFrame([("EQ-1", "M1", "mixer", "L", "P", None, None)],
                                     "equipment_id string, name string, type string, line_id string, plant_id string,"
                                     " capacity_kg_h int, commissioned_year int")
    assert serving.equipment_status(registry, g).count() == 2


def test_flow_utilisation_is_capped(spark):
    raw = make_raw(spark, [
        {"equipment_id": "A", "event_ts": ts("2024-01-01T00:01:00"), "flow_rate_l_min": 2500.0},
        {"equipment_id": "B", "event_ts": ts("2024-01-01T00:02:00"), "flow_rate_l_min": 6000.0},
        {"equipment_id": "C", "event_ts": ts("2024-01-01T00:03:00")},
    ])
    g = equipment_metrics(to_silver(to_bronze(raw)), computed_at=False)
    got = {r["equipment_id"]: r["flow_utilisation_pct"] for r in serving.equipment_grid(g).collect()}
    assert got == {"A": 50.0, "B": 100.0, "C": 0.0}


def test_dashboard_trend_flags(spark):
    raw = make_raw(spark, [
        {"event_type": "alarm", "event_ts": ts("2024-01-01T00:01:00"), "temperature_c": 90.0, "energy_kwh": 5.0},
        {"event_type": "quality_check", "batch_id": "B", "first_time_right": True, "moisture_pct": 4.0,
         "event_ts": ts("2024-01-01T00:02:00")},
    ])
    s = to_silver(to_bronze(raw))
    from sensortwin.operators.gold import batch_yield
    r = serving.dashboard_kpis(equipment_metrics(s, computed_at=False), batch_yield(s, computed_at=False)).first()
    assert r["total_alarms"] == 1 and r["alarms_trend"] == "down"
    assert r["avg_ftr_rate_pct"] == 100.0 and r["ftr_trend"] == "up"
    assert r["avg_moisture_compliance_pct"] == 100.0 and r["compliance_trend"] == "up"


def test_energy_intensity_and_target(spark):
    cols = "plant_id string, total_energy_kwh double, total_water_liters double, cip_water_liters double, " \
           "estimated_co2_kg double, water_alarm_count int"
    dry = serving.sustainability_kpis(spark.createDataFrame([("P", 10.0, 0.0, 0.0, 2.33, 0)], cols)).first()
    assert dry["energy_intensity_kwh_per_kl"] is None and dry["meets_target"] is False
    wet = serving.sustainability_kpis(spark.createDataFrame([("P", 4.0, 1000.0, 0.0, 0.93, 0),
                                                             ("Q", 0.0, 1000.0, 0.0, 0.0, 0)], cols)).first()
    assert wet["energy_intensity_kwh_per_kl"] == 2.0 and wet["meets_target"] is True


def test_live_feed_order_and_limits(spark):
    raw = make_raw(spark, [{"event_ts": ts(f"2024-01-01T00:00:{s:02d}"), "temperature_c": float(s)}
                           for s in range(0, 50)])
    s = to_silver(to_bronze(raw))
    as_of = ts("2024-01-01T00:00:49")
    poll = [r["temperature_c"] for r in serving.recent_events(s, as_of, seconds=30, limit=5).collect()]
    assert poll == [49.0, 48.0, 47.0, 46.0, 45.0]                     # newest first, capped
    hist = [r["temperature_c"] for r in serving.event_history(s, as_of, seconds=10, limit=500).collect()]
    assert hist == [float(x) for x in range(39, 50)]                  # oldest first, horizon inclusive
    feed = serving.event_feed(s, as_of, rows=3).collect()
    assert [r["temperature_c"] for r in feed] == [49.0, 48.0, 47.0] and feed[0]["time"] == "00:00:49"


def test_event_rate_counts_new_events_once(spark):
    rows = [{"event_id": f"e{i}", "event_ts": ts(f"2024-01-01T00:00:0{i % 5}")} for i in range(12)]
    rows += [{"event_id": "dup", "event_ts": ts("2024-01-01T00:00:00")}]          # a repeat of e0's key
    rows += [{"event_id": f"n{i}", "event_ts": ts("2024-01-01T00:00:07"), "equipment_id": f"EQ-{i}"} for i in range(3)]
    s = to_silver(to_bronze(make_raw(spark, rows)))
    got = [(r["tick_start"].second, r["new_events"], r["events_per_sec"]) for r in serving.event_rate(s).collect()]
    assert got == [(0, 5, 1), (5, 3, 1)]   # 5 distinct keys in the first tick (12 rows + a repeat)


def test_live_series_averages_non_null_values(spark):
    raw = make_raw(spark, [
        {"event_ts": ts("2024-01-01T10:00:00.100000"), "temperature_c": 1.0, "energy_kwh": 1.005},
        {"event_ts": ts("2024-01-01T10:00:00.900000"), "temperature_c": 2.0},
        {"event_ts": ts("2024-01-01T10:00:01"), "moisture_pct": 4.0},
    ])
    got = serving.live_series(to_silver(to_bronze(raw))).collect()
    assert [(r["label"], r["temp"], r["energy"], r["moisture"]) for r in got] == [
        ("10:00:00", 1.5, 1.01, None), ("10:00:01", None, None, 4.0)]


def test_hourly_trend_sums_across_plants(spark):
    cols = ("plant_id string, line_id string, hour_bucket timestamp, event_date date, estimated_co2_kg double, "
            "total_energy_kwh double, total_water_liters double, cip_water_liters double")
    import datetime as dt
    h = ts("2024-01-01T05:00:00")
    sus = spark.createDataFrame([("P1", "L1", h, dt.date(2024, 1, 1), 1.0, 10.0, 100.0, None),
                                 ("P2", "L2", h, dt.date(2024, 1, 1), None, 5.0, 50.0, 20.0)], cols)
    r = serving.hourly_trend(sus, hours=0).collect()
    assert len(r) == 1 and r[0]["label"] == "05:00"
    assert (r[0]["co2_kg"], r[0]["energy_kwh"], r[0]["water_liters"], r[0]["cip_water_liters"]) == (1.0, 15.0, 150.0, 20.0)


def test_carbon_insight_gap(spark):
    import datetime as dt
    e1, e2 = 10.0 / 0.233, 5.0 / 0.233   # -> 10.0 and 5.0 kg CO2 after rounding
    gb = spark.createDataFrame(
        [("HI", "P", ["L"], 1.0, 27.0, 900.0, e1, 1.0, dt.datetime(2024, 1, 2), 1.0, 1.0, 3),
         ("LO", "P", ["L"], 1.0, 25.0, 800.0, e2, 1.0, dt.datetime(2024, 1, 1), 1.0, 1.0, 3)],
        "batch_id string, plant_id string, line_ids array<string>, avg_protein_pct double, avg_fat_pct double, "
        "avg_viscosity_cp double, total_energy_kwh double, ftr_rate_pct double, batch_first_seen timestamp, "
        "avg_moisture_pct double, moisture_compliance_pct double, total_events long")
    tb = {r["batch_id"]: r for r in serving.carbon_traceback(gb).collect()}
    assert tb["HI"]["co2_rank"] == 1 and tb["HI"]["severity"] == "alarm" and tb["LO"]["severity"] == "ok"
    ins = serving.carbon_insight(serving.carbon_traceback(gb)).first()
    assert (ins["worst_batch_id"], ins["best_batch_id"]) == ("HI", "LO") and abs(ins["gap_pct"] - 100.0) < 1e-9


def test_batch_badge_thresholds(spark):
    import datetime as dt
    gb = spark.createDataFrame(
        [(f"B{i}", "P", dt.datetime(2024, 1, 1, i), c, f) for i, (c, f) in
         enumerate([(95.0, 95.0), (94.9, 94.9), (80.0, None), (79.9, 100.0), (None, 96.0)])],
        "batch_id string, plant_id string, batch_first_seen timestamp, moisture_compliance_pct double, "
        "ftr_rate_pct double")
    got = {r["batch_id"]: (r["compliance_badge"], r["ftr_badge"]) for r in serving.batch_badges(gb).collect()}
    assert got == {"B0": ("ok", "ok"), "B1": ("warning", "warning"), "B2": ("warning", "warning"),
                   "B3": ("alarm", "ok"), "B4": ("alarm", "ok")}
