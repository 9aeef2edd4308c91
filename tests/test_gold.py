"""Gold aggregates (A1-A3): bucket edges, zero denominators, partial merge, properties."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sensortwin.operators.gold import (batch_partials, batch_yield, batch_yield_from_partials, equipment_metrics,
                                       sustainability_hourly)
from sensortwin.operators.layers import to_bronze, to_silver
from sensortwin.plans.inputs import Inputs

from twin_rows import SF_SMALL, make_raw, ts


def _silver(spark, rows):
    return to_silver(to_bronze(make_raw(spark, rows)))


def test_five_minute_bucket_edges(spark):
    s = _silver(spark, [
        {"event_ts": ts("2024-01-01T00:04:59.999999"), "temperature_c": 10.0},
        {"event_ts": ts("2024-01-01T00:05:00"), "temperature_c": 20.0},
        {"event_ts": ts("2024-01-01T00:09:59"), "temperature_c": 30.0},
        {"event_ts": ts("2024-01-01T00:05:01"), "event_type": "batch_start"},  # not a measured type
    ])
    rows = sorted(equipment_metrics(s, computed_at=False).collect(), key=lambda r: r["window_5min"])
    assert [r["window_5min"].minute for r in rows] == [0, 5]
    assert [r["event_count"] for r in rows] == [1, 2]
    assert rows[1]["avg_temperature_c"] == 25.0


def test_ftr_and_alarm_types(spark):
    s = _silver(spark, [
        {"event_type": "quality_check", "first_time_right": True},
        {"event_type": "quality_check", "first_time_right": False},
        {"event_type": "quality_check", "first_time_right": True},
        {"event_type": "alarm", "alarm_code": "A"},
        {"event_type": "alarm", "alarm_code": "A"},
        {"event_type": "alarm", "alarm_code": "B"},
        {"event_type": "sensor_reading", "alarm_code": "C"},  # code on a non-alarm row is ignored
    ])
    r = equipment_metrics(s, computed_at=False).first()
    assert r["quality_check_count"] == 3 and r["ftr_pass_count"] == 2 and r["ftr_rate_pct"] == 66.7
    assert r["alarm_count"] == 3 and r["distinct_alarm_types"] == 2


def test_ftr_rate_null_without_checks(spark):
    s = _silver(spark, [{"temperature_c": 1.0}])
    r = equipment_metrics(s, computed_at=False).first()
    assert r["quality_check_count"] == 0 and r["ftr_rate_pct"] is None and r["ftr_pass_count"] is None


def test_batch_compliance_and_two_plants(spark):
    s = _silver(spark, [
        {"batch_id": "B1", "moisture_pct": 4.0},
        {"batch_id": "B1", "moisture_pct": 2.7},   # MARGINAL stays in the denominator
        {"batch_id": "B1", "moisture_pct": 6.0},
        {"batch_id": "B1", "plant_id": "PLANT-2", "energy_kwh": 0.0},
        {"batch_id": None, "moisture_pct": 4.0},
    ])
    rows = {(r["batch_id"], r["plant_id"]): r for r in batch_yield(s, computed_at=False).collect()}
    assert set(rows) == {("B1", "PLANT-1"), ("B1", "PLANT-2")}
    p1 = rows[("B1", "PLANT-1")]
    assert p1["moisture_in_spec_count"] == 1 and p1["moisture_out_of_spec_count"] == 1
    assert p1["moisture_compliance_pct"] == 33.3
    assert p1["equipment_ids"] == ["EQ-1"]
    assert rows[("B1", "PLANT-2")]["moisture_compliance_pct"] is None  # no moisture reading


def test_sustainability_ratios_and_co2(spark):
    s = _silver(spark, [
        {"equipment_type": "cip_unit", "water_liters": 100.0, "energy_kwh": 10.0},
        {"equipment_type": "spray_dryer", "water_steam_liters": 5.0, "powder_output_kg_h": 20.0,
         "energy_kwh": 1.005 / 0.233},
        {"equipment_type": "mixer", "alarm_code": "WATER_OVERCONSUMPTION", "event_type": "alarm"},
    ])
    r = sustainability_hourly(s, computed_at=False).first()
    assert r["cip_water_liters"] == 100.0 and r["dryer_steam_liters"] == 5.0
    assert r["water_per_kg_powder_l"] == 5.0
    assert r["energy_per_kg_powder_kwh"] == round((10.0 + 1.005 / 0.233) / 20.0, 3)
    assert r["water_alarm_count"] == 1 and r["alarm_count"] == 1
    assert r["active_equipment_count"] == 1 and r["batches_processed"] == 0


def test_no_powder_gives_null_ratios(spark):
    r = sustainability_hourly(_silver(spark, [{"energy_kwh": 5.0}]), computed_at=False).first()
    assert r["water_per_kg_powder_l"] is None and r["energy_per_kg_powder_kwh"] is None


def test_partials_merge_equals_direct(spark):
    t = Inputs(spark, SF_SMALL)
    direct = {(r["batch_id"], r["plant_id"]): r.asDict() for r in t.gold_batch.collect()}
    merged = {(r["batch_id"], r["plant_id"]): r.asDict()
              for r in batch_yield_from_partials(batch_partials(t.silver), computed_at=False).collect()}
    assert direct.keys() == merged.keys()
    for k, d in direct.items():
        m = merged[k]
        for c, v in d.items():
            if isinstance(v, float):
                assert math.isclose(v, m[c], rel_tol=1e-9, abs_tol=1e-9), (k, c)
            else:
                assert v == m[c], (k, c)


def test_properties_on_fixture(spark):
    t = Inputs(spark, SF_SMALL)
    measured = t.silver.filter(F.col("event_type").isin("sensor_reading", "alarm", "quality_check")).count()
    assert t.gold_eq.agg(F.sum("event_count")).first()[0] == measured
    assert t.gold_sus.agg(F.sum("total_events")).first()[0] == t.silver.count()
    bad = t.gold_batch.filter((F.col("moisture_compliance_pct") < 0) | (F.col("moisture_compliance_pct") > 100))
    assert bad.count() == 0
    hourly = t.gold_sus.agg(F.sum("total_energy_kwh")).first()[0]
    summary = t.summary.agg(F.sum("total_energy_kwh")).first()[0]
    assert math.isclose(hourly, summary, rel_tol=1e-12)


def test_partials_merge_randomized_edges(spark):
    """Random batches spread over days, with single-row days, all-NULL days and large values:
    the daily-partials merge equals the direct aggregate (stddev via Chan's formula)."""
    import random
    rng = random.Random(5)
    rows = []
    for i in range(600):
        b = f"B{rng.randint(0, 30)}"
        day = rng.randint(1, 12)
        m = None if rng.random() < 0.3 else rng.choice([rng.uniform(2, 6), 1e6 + rng.uniform(0, 1), 4.0])
        rows.append({"event_id": f"r{i}", "batch_id": b, "plant_id": rng.choice(["P1", "P2"]),
                     "event_ts": ts(f"2024-01-{day:02d}T{rng.randint(0, 23):02d}:00:00"),
                     "moisture_pct": m, "energy_kwh": rng.choice([None, rng.uniform(0, 500)]),
                     "event_type": rng.choice(["sensor_reading", "quality_check", "alarm"]),
                     "first_time_right": rng.choice([None, True, False])})
    rows.append({"event_id": "solo", "batch_id": "SOLO", "plant_id": "P1", "moisture_pct": 3.3})
    s = _silver(spark, rows)
    direct = {(r["batch_id"], r["plant_id"]): r.asDict() for r in batch_yield(s, computed_at=False).collect()}
    merged = {(r["batch_id"], r["plant_id"]): r.asDict()
              for r in batch_yield_from_partials(batch_partials(s), computed_at=False).collect()}
    assert direct.keys() == merged.keys()
    assert merged[("SOLO", "P1")]["stddev_moisture_pct"] is None
    for k, d in direct.items():
        for c, v in d.items():
            w = merged[k][c]
            if isinstance(v, float):
                assert w is not None and math.isclose(v, w, rel_tol=1e-7, abs_tol=1e-6), (k, c, v, w)
            else:
                assert v == w, (k, c, v, w)


def test_partials_stddev_large_mean_small_spread(spark):
    """Values near 1e6 with sigma 0.3 over 20 days: the merged stddev keeps full precision."""
    import random
    rng = random.Random(1)
    rows = [{"event_id": f"r{i}", "batch_id": "B", "event_ts": ts(f"2024-01-{rng.randint(1, 20):02d}T00:00:00"),
             "moisture_pct": 1e6 + rng.gauss(0, 0.3)} for i in range(2000)]
    s = _silver(spark, rows)
    d = batch_yield(s, computed_at=False).first()["stddev_moisture_pct"]
    m = batch_yield_from_partials(batch_partials(s), computed_at=False).first()["stddev_moisture_pct"]
    assert math.isclose(d, m, rel_tol=1e-9)


def test_zero_compliance_batch(spark):
    s = _silver(spark, [{"batch_id": "B0", "moisture_pct": 6.0}, {"batch_id": "B0", "moisture_pct": 1.0}])
    r = batch_yield(s, computed_at=False).first()
    assert r["moisture_compliance_pct"] == 0.0 and r["moisture_out_of_spec_count"] == 2
    assert r["quality_checks"] == 0 and r["ftr_rate_pct"] is None


def test_approximate_distinct_counts_are_close(spark):
    t = Inputs(spark, SF_SMALL)
    exact = {(r["plant_id"], r["line_id"], r["hour_bucket"]): r for r in t.gold_sus.collect()}
    approx = {(r["plant_id"], r["line_id"], r["hour_bucket"]): r
              for r in sustainability_hourly(t.silver, computed_at=False, approx_rsd=0.01).collect()}
    assert exact.keys() == approx.keys()
    for k, e in exact.items():
        for c in ("active_equipment_count", "batches_processed"):
            assert abs(approx[k][c] - e[c]) <= max(1, 0.05 * e[c]), (k, c)
    eq = equipment_metrics(t.silver, computed_at=False, approx_rsd=0.01)
    assert eq.count() == t.gold_eq.count()
