"""What-if scoring (K10-K14, J3, J4): a scenario table in, one projected row per scenario.

The application scores one request at a time in Python; here every scenario is a row
and the model is a set of column expressions -- applied after one equi-join of the
requests to the batch table (``what_if``), or directly on a grid exploded from the batch
rows, which already carry their baseline (``scenario_grid`` + ``score_scenarios``).
Rounding uses SQL ``round`` (half up) throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C

SCENARIO_KEYS = ("batch_id", "plant_id", "fat_delta_pct", "protein_delta_pct", "heat_setting_c")


SCENARIO_DEFAULTS = (("fat_delta_pct", 0.0), ("protein_delta_pct", 0.0), ("heat_setting_c", C.BASE_HEAT_C))


def with_scenario_defaults(scenarios: DataFrame) -> DataFrame:
    """Fill the optional request fields: a NULL or absent column takes its default (0, 0, 72)."""
    filled = {c: (F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in scenarios.columns else F.lit(d))
              for c, d in SCENARIO_DEFAULTS}
    return scenarios.withColumns(filled)


def validate_scenarios(scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected).  Defaults 0 / 0 / 72; ranges inclusive; batch id required."""
    s = with_scenario_defaults(scenarios)
    ok = (F.col("batch_id").isNotNull()
          & F.col("fat_delta_pct").between(*C.FAT_DELTA_RANGE)
          & F.col("protein_delta_pct").between(*C.PROTEIN_DELTA_RANGE)
          & F.col("heat_setting_c").between(*C.HEAT_RANGE))
    reason = (F.when(F.col("batch_id").isNull(), "batch_id required")
              .when(~F.col("fat_delta_pct").between(*C.FAT_DELTA_RANGE), "fat_delta_pct out of range")
              .when(~F.col("protein_delta_pct").between(*C.PROTEIN_DELTA_RANGE), "protein_delta_pct out of range")
              .otherwise("heat_setting_c out of range"))
    return s.filter(ok), s.filter(~ok).withColumn("reason", reason)


BASELINE_COLUMNS = ("avg_viscosity_cp", "avg_protein_pct", "avg_fat_pct", "total_energy_kwh", "ftr_rate_pct",
                    "alarm_count")


def scenario_grid(batches: DataFrame, step: float = C.DELTA_STEP, presets=C.HEAT_PRESETS) -> DataFrame:
    """Per batch row, every fat and protein delta on the slider grid x the heat presets.

    A fixed-size fan-out per batch row with ``explode`` -- no join.  All columns of
    ``batches`` are kept, so a grid built from the batch table already carries its
    baseline and can be scored directly (``score_scenarios``) without joining back.
    """
    steps = int(round(1.0 / step))
    deltas = F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda i: i / F.lit(float(steps)))
    heats = F.array(*[F.struct(F.lit(name).alias("preset"), F.lit(float(t)).alias("heat_setting_c"))
                      for name, t in presets])
    return (batches
            .select("*", F.explode(deltas).alias("fat_delta_pct"))
            .select("*", F.explode(deltas).alias("protein_delta_pct"))
            .select("*", F.explode(heats).alias("_h"))
            .select(*batches.columns, "fat_delta_pct", "protein_delta_pct",
                    F.col("_h.heat_setting_c").alias("heat_setting_c"), F.col("_h.preset").alias("preset")))


def preset_requests(batch_ids: DataFrame, presets=C.HEAT_PRESETS) -> DataFrame:
    """Simulator requests for listed batches: each heat preset with unchanged milk."""
    heats = F.array(*[F.struct(F.lit(name).alias("preset"), F.lit(float(t)).alias("heat_setting_c"))
                      for name, t in presets])
    return (batch_ids.select("batch_id").distinct()
            .select("batch_id", F.explode(heats).alias("_h"))
            .select("batch_id", F.lit(0.0).alias("fat_delta_pct"), F.lit(0.0).alias("protein_delta_pct"),
                    F.col("_h.heat_setting_c").alias("heat_setting_c"), F.col("_h.preset").alias("preset")))


def _or(col: str, default):
    """Python ``x or d``: NULL *and* 0 become ``d``."""
    return F.coalesce(F.nullif(F.col(col).cast("double"), F.lit(0.0)), F.lit(float(default)))


def what_if(scenarios: DataFrame, gold_batch: DataFrame, one_per_batch: bool = False) -> DataFrame:
    """K10 + J3: score scenario requests against their batch baseline.

    Requests carry ``batch_id`` (and optionally ``plant_id``); an inner equi-join picks
    the baseline rows -- without a plant, every plant's row, so a batch seen in two
    plants scores twice.  ``one_per_batch=True`` keeps one baseline per batch instead,
    deterministically the smallest plant id (T7: the application takes an arbitrary
    ``LIMIT 1`` row), chosen by a ``min_by`` aggregate.  No broadcast hint: AQE picks
    broadcast from measured sizes.
    """
    s = with_scenario_defaults(scenarios)
    base_cols = gold_batch.select("batch_id", "plant_id", *BASELINE_COLUMNS)
    if one_per_batch:
        s = s.drop("plant_id") if "plant_id" in s.columns else s
        first = F.min_by(F.struct("plant_id", *BASELINE_COLUMNS), F.col("plant_id")).alias("_b")
        base_cols = base_cols.groupBy("batch_id").agg(first).select("batch_id", "_b.*")
    keys = ["batch_id", "plant_id"] if "plant_id" in s.columns else ["batch_id"]
    return score_scenarios(s.join(base_cols, keys))


def score_scenarios(j: DataFrame) -> DataFrame:
    """The what-if model on rows holding both a scenario and its baseline columns."""
    j = with_scenario_defaults(j)

    energy = F.coalesce(F.nullif(F.col("total_energy_kwh").cast("double"), F.lit(0.0)), F.lit(0.0))
    visc, fat, prot, ftr = (_or("avg_viscosity_cp", C.DEFAULT_VISCOSITY), _or("avg_fat_pct", C.DEFAULT_FAT),
                            _or("avg_protein_pct", C.DEFAULT_PROTEIN), _or("ftr_rate_pct", C.DEFAULT_FTR))
    alarms = F.coalesce(F.nullif(F.col("alarm_count").cast("long"), F.lit(0)), F.lit(C.DEFAULT_ALARM_COUNT))
    dfat, dprot, heat = F.col("fat_delta_pct"), F.col("protein_delta_pct"), F.col("heat_setting_c")

    m = j.select(*[c for c in j.columns if c not in BASELINE_COLUMNS],
                 energy.alias("_e"), visc.alias("_v"), fat.alias("_f"), prot.alias("_p"), ftr.alias("_ftr"),
                 F.greatest(alarms * 0.5, F.lit(1.0)).alias("_vol"))
    e, v, vol = F.col("_e"), F.col("_v"), F.col("_vol")
    new_v = v + dprot * C.PROTEIN_VISCOSITY_COEFF * 10.0
    heat_d = heat - C.BASE_HEAT_C
    m = m.select("*", new_v.alias("_nv"), heat_d.alias("_hd"))
    nv, hd = F.col("_nv"), F.col("_hd")
    energy_d = (dfat * C.FAT_ENERGY_COEFF * vol + (nv - v) * C.VISCOSITY_ENERGY_COEFF * vol
                + hd * C.TEMP_ENERGY_COEFF * vol)
    m = m.select("*", energy_d.alias("_ed"))
    new_e = F.greatest(e + F.col("_ed"), F.lit(0.0))
    quality = F.least(F.lit(100.0), F.greatest(F.lit(0.0), C.BASE_QUALITY + hd * C.TEMP_QUALITY_COEFF
                                              + dfat * C.FAT_QUALITY_COEFF))
    m = m.select("*", new_e.alias("_ne"), quality.alias("_q"))
    ne, q = F.col("_ne"), F.col("_q")
    pct = F.when(e != 0, (ne - e) / e * 100.0).otherwise(F.lit(0.0))
    m = m.select("*", pct.alias("_pct"))
    p = F.col("_pct")
    rec = (F.when((p < -5) & (q >= C.BASE_QUALITY), C.RECOMMENDATIONS[0])
           .when(p > 10, C.RECOMMENDATIONS[1])
           .when(q > C.BASE_QUALITY + 5, C.RECOMMENDATIONS[2])
           .when(q < C.BASE_QUALITY - 5, C.RECOMMENDATIONS[3])
           .otherwise(C.RECOMMENDATIONS[4]))
    co2, base_co2 = ne * C.CO2_KG_PER_KWH, e * C.CO2_KG_PER_KWH
    lead = [c for c in ("batch_id", "plant_id", "preset", "fat_delta_pct", "protein_delta_pct", "heat_setting_c")
            if c in m.columns]
    keep = lead + [c for c in m.columns if not c.startswith("_") and c not in lead]
    return m.select(
        *keep,
        F.col("_f").alias("base_fat_pct"), F.col("_p").alias("base_protein_pct"),
        v.alias("base_viscosity_cp"), F.round(e, 2).alias("base_energy_kwh"),
        F.round(base_co2, 2).alias("base_co2_kg"), F.round(F.lit(C.BASE_QUALITY), 1).alias("base_quality_score"),
        F.round(F.col("_ftr"), 1).alias("base_ftr_rate_pct"),
        F.round(F.col("_f") + dfat, 2).alias("sim_fat_pct"), F.round(F.col("_p") + dprot, 2).alias("sim_protein_pct"),
        F.round(nv, 1).alias("sim_viscosity_cp"), F.round(ne, 2).alias("sim_energy_kwh"),
        F.round(co2, 2).alias("sim_co2_kg"), F.round(q, 1).alias("sim_quality_score"),
        F.round(F.col("_ed"), 2).alias("delta_energy_kwh"), F.round(p, 1).alias("delta_energy_pct"),
        F.round(co2 - base_co2, 2).alias("delta_co2_kg"), F.round(q - C.BASE_QUALITY, 1).alias("delta_quality_score"),
        rec.alias("recommendation"))


def unknown_batches(scenarios: DataFrame, gold_batch: DataFrame) -> DataFrame:
    """Scenarios naming a batch that has no baseline (the 404 case), as a left-anti join."""
    return scenarios.join(gold_batch.select("batch_id"), "batch_id", "left_anti")


def what_if_scores(result: DataFrame) -> DataFrame:
    """The five 0-100 comparison scores in long form (one row per scenario x metric)."""
    keys = [c for c in SCENARIO_KEYS if c in result.columns]
    metrics = [
        ("Quality", F.col("base_quality_score"), F.col("sim_quality_score")),
        ("Energy Eff.", F.greatest(F.lit(0.0), 100.0 - F.col("base_energy_kwh") / 2.0),
         F.greatest(F.lit(0.0), 100.0 - F.col("sim_energy_kwh") / 2.0)),
        ("FTR", F.col("base_ftr_rate_pct"), F.col("base_ftr_rate_pct") + F.col("delta_quality_score") * 0.3),
        ("CO2 Eff.", F.greatest(F.lit(0.0), 100.0 - F.col("base_co2_kg")),
         F.greatest(F.lit(0.0), 100.0 - F.col("sim_co2_kg"))),
        ("Viscosity", F.least(F.lit(100.0), F.col("base_viscosity_cp") / 2.0),
         F.least(F.lit(100.0), F.col("sim_viscosity_cp") / 2.0)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), b.cast("double").alias("baseline"),
                              s.cast("double").alias("simulated")) for n, b, s in metrics])
    return result.select(*keys, F.inline(rows))


def what_if_compare(result: DataFrame) -> DataFrame:
    """Baseline / simulated / delta per parameter in long form."""
    keys = [c for c in SCENARIO_KEYS if c in result.columns]
    params = [("Fat %", "fat_pct"), ("Protein %", "protein_pct"), ("Viscosity (cP)", "viscosity_cp"),
              ("Energy (kWh)", "energy_kwh"), ("CO2 (kg)", "co2_kg"), ("Quality Score", "quality_score")]
    rows = F.array(*[F.struct(F.lit(label).alias("parameter"), F.col(f"base_{c}").cast("double").alias("baseline"),
                              F.col(f"sim_{c}").cast("double").alias("simulated")) for label, c in params])
    return (result.select(*keys, F.inline(rows))
            .withColumn("delta", F.col("simulated") - F.col("baseline")))
