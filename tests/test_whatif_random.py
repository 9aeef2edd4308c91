"""Randomized check of the what-if model against a plain-Python statement of the formulas.

400 random baselines (including NULL and 0 values, which the application replaces by
defaults) and requests are scored in one Spark job and compared row by row.
"""

from __future__ import annotations

import random
from decimal import ROUND_HALF_UP, Decimal

from sensortwin import config as C
from sensortwin.operators import whatif
from sensortwin.schemas import SCENARIO_SCHEMA

BATCH_COLS = ("batch_id string, plant_id string, avg_viscosity_cp double, avg_protein_pct double, "
              "avg_fat_pct double, total_energy_kwh double, ftr_rate_pct double, alarm_count long")


def sql_round(x: float, digits: int) -> float:
    """Half-up on the shortest decimal text of the double (SQL ``round`` semantics)."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP))


def expected(b: dict, fat_d: float, prot_d: float, heat: float) -> dict:
    energy = b["total_energy_kwh"] or 0.0
    visc = b["avg_viscosity_cp"] or C.DEFAULT_VISCOSITY
    fat = b["avg_fat_pct"] or C.DEFAULT_FAT
    prot = b["avg_protein_pct"] or C.DEFAULT_PROTEIN
    ftr = b["ftr_rate_pct"] or C.DEFAULT_FTR
    alarms = b["alarm_count"] or C.DEFAULT_ALARM_COUNT
    vol = max(alarms * 0.5, 1.0)
    new_visc = visc + prot_d * C.PROTEIN_VISCOSITY_COEFF * 10.0
    heat_d = heat - C.BASE_HEAT_C
    e_delta = (fat_d * C.FAT_ENERGY_COEFF * vol + (new_visc - visc) * C.VISCOSITY_ENERGY_COEFF * vol
               + heat_d * C.TEMP_ENERGY_COEFF * vol)
    new_e = max(energy + e_delta, 0.0)
    q = min(100.0, max(0.0, C.BASE_QUALITY + heat_d * C.TEMP_QUALITY_COEFF + fat_d * C.FAT_QUALITY_COEFF))
    pct = (new_e - energy) / energy * 100.0 if energy else 0.0
    if pct < -5 and q >= C.BASE_QUALITY:
        rec = 0
    elif pct > 10:
        rec = 1
    elif q > C.BASE_QUALITY + 5:
        rec = 2
    elif q < C.BASE_QUALITY - 5:
        rec = 3
    else:
        rec = 4
    return {
        "base_fat_pct": fat, "base_protein_pct": prot, "base_viscosity_cp": visc,
        "base_energy_kwh": sql_round(energy, 2), "base_co2_kg": sql_round(energy * C.CO2_KG_PER_KWH, 2),
        "base_ftr_rate_pct": sql_round(ftr, 1),
        "sim_fat_pct": sql_round(fat + fat_d, 2), "sim_protein_pct": sql_round(prot + prot_d, 2),
        "sim_viscosity_cp": sql_round(new_visc, 1), "sim_energy_kwh": sql_round(new_e, 2),
        "sim_co2_kg": sql_round(new_e * C.CO2_KG_PER_KWH, 2), "sim_quality_score": sql_round(q, 1),
        "delta_energy_kwh": sql_round(e_delta, 2), "delta_energy_pct": sql_round(pct, 1),
        "delta_co2_kg": sql_round(new_e * C.CO2_KG_PER_KWH - energy * C.CO2_KG_PER_KWH, 2),
        "delta_quality_score": sql_round(q - C.BASE_QUALITY, 1), "recommendation": C.RECOMMENDATIONS[rec],
    }


def _maybe(rng: random.Random, lo: float, hi: float):
    r = rng.random()
    if r < 0.08:
        return None
    if r < 0.16:
        return 0.0
    return round(rng.uniform(lo, hi), 3)


def test_what_if_matches_formulas(spark):
    rng = random.Random(7)
    batches, scenarios = [], []
    for i in range(400):
        b = {"batch_id": f"B{i}", "plant_id": "P", "avg_viscosity_cp": _maybe(rng, 500, 1200),
             "avg_protein_pct": _maybe(rng, 28, 36), "avg_fat_pct": _maybe(rng, 22, 30),
             "total_energy_kwh": _maybe(rng, 0.1, 5000), "ftr_rate_pct": _maybe(rng, 50, 100),
             "alarm_count": rng.choice([None, 0, 1, 2, 3, 7, 40])}
        batches.append(b)
        scenarios.append((f"B{i}", rng.randint(-10, 10) / 10.0, rng.randint(-10, 10) / 10.0,
                          float(rng.randint(60, 95))))
    bdf = spark.createDataFrame([tuple(b[c.split()[0]] for c in BATCH_COLS.split(", ")) for b in batches],
                                BATCH_COLS)
    sdf = spark.createDataFrame(scenarios, SCENARIO_SCHEMA)
    got = {r["batch_id"]: r.asDict() for r in whatif.what_if(sdf, bdf).collect()}
    assert len(got) == 400
    for b, (bid, fd, pd, heat) in zip(batches, scenarios):
        exp = expected(b, fd, pd, heat)
        row = got[bid]
        for k, v in exp.items():
            if isinstance(v, float):
                assert abs(row[k] - v) < 1e-9, (bid, k, row[k], v, b, fd, pd, heat)
            else:
                assert row[k] == v, (bid, k, row[k], v)
