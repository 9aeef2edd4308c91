"""Gold aggregates (A1-A3) and the mergeable daily partials behind incremental refresh.

Each aggregate is one ``groupBy().agg()``: Spark plans a partial (map-side) aggregate
(hash-based; object-hash for the collected sets of batch yield), one shuffle on the
group keys, and a final merge, so a hot key costs one partial row per input partition,
never a skewed task.  Distinct counts use Spark's
distinct-aggregate rewrite (two-level partial aggregation) rather than collecting sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import bool_count, bucket_start, case_count, pct, trunc_like

EQUIPMENT_KEYS = ("equipment_id", "equipment_name", "equipment_type", "line_id", "plant_id")
BATCH_KEYS = ("batch_id", "plant_id")
SUSTAINABILITY_KEYS = ("plant_id", "line_id")


def _computed(computed_at) -> list[Column]:
    if computed_at is False:
        return []
    now = F.current_timestamp() if computed_at is None else F.lit(computed_at).cast("timestamp")
    return [now.alias("_computed_at")]


def _distinct(col: Column, approx_rsd: float | None) -> Column:
    """``COUNT(DISTINCT col)``; with ``approx_rsd`` the HyperLogLog++ estimate (one exchange,
    no distinct rewrite) at that relative standard deviation."""
    if approx_rsd is None:
        return F.count_distinct(col)
    return F.approx_count_distinct(col, approx_rsd)


def equipment_metrics(silver: DataFrame, window: str = C.EQUIPMENT_WINDOW,
                      computed_at=None, approx_rsd: float | None = None) -> DataFrame:
    """A1: per machine identity x 5-minute bucket x date (measured event types only).

    The distinct alarm types are counted in the same exchange as a set per group, which the
    fixed alarm vocabulary bounds; ``approx_rsd`` switches to an estimate (exact by default)."""
    s = silver.filter(F.col("event_type").isin(*C.MEASURED_EVENT_TYPES))
    return (s.groupBy(*EQUIPMENT_KEYS, bucket_start("event_ts", window).alias("window_5min"), "event_date")
            .agg(*equipment_aggs(approx_rsd), *_computed(computed_at)))


def equipment_aggs(approx_rsd: float | None = None) -> list[Column]:
    """The aggregates of A1 over silver rows."""
    alarm = F.when(F.col("is_alarm"), F.col("alarm_code"))
    qc = bool_count("is_quality_check")
    ftr = bool_count("first_time_right")
    return [F.count(F.lit(1)).alias("event_count"),
            F.avg("temperature_c").alias("avg_temperature_c"),
            F.min("temperature_c").alias("min_temperature_c"),
            F.max("temperature_c").alias("max_temperature_c"),
            F.avg("inlet_temperature_c").alias("avg_inlet_temp_c"),
            F.avg("outlet_temperature_c").alias("avg_outlet_temp_c"),
            F.avg("pressure_kpa").alias("avg_pressure_kpa"),
            F.max("pressure_kpa").alias("max_pressure_kpa"),
            F.avg("flow_rate_l_min").alias("avg_flow_rate_l_min"),
            F.sum("energy_kwh").alias("total_energy_kwh"),
            F.sum("water_liters").alias("total_water_liters"),
            F.sum("water_steam_liters").alias("total_steam_liters"),
            F.avg("energy_kwh").alias("avg_energy_kwh"),
            F.avg("moisture_pct").alias("avg_moisture_pct"),
            F.avg("viscosity_cp").alias("avg_viscosity_cp"),
            F.avg("protein_pct").alias("avg_protein_pct"),
            F.avg("fat_pct").alias("avg_fat_pct"),
            F.avg("powder_output_kg_h").alias("avg_powder_output_kg_h"),
            bool_count("is_alarm").alias("alarm_count"),
            (F.size(F.collect_set(alarm)).cast("long") if approx_rsd is None else F.approx_count_distinct(alarm, approx_rsd)
             ).alias("distinct_alarm_types"),
            ftr.alias("ftr_pass_count"),
            qc.alias("quality_check_count"),
            F.when(qc > 0, pct(ftr, qc)).alias("ftr_rate_pct")]


def _batch_aggs() -> list[Column]:
    in_spec = case_count(F.col("moisture_quality") == F.lit("IN_SPEC"))
    measured = case_count(F.col("moisture_pct").isNotNull())
    ftr = bool_count("first_time_right")
    qc = bool_count("is_quality_check")
    return [
        F.sort_array(F.collect_set("equipment_id")).alias("equipment_ids"),
        F.sort_array(F.collect_set("equipment_type")).alias("equipment_types"),
        F.sort_array(F.collect_set("line_id")).alias("line_ids"),
        F.min("event_ts").alias("batch_first_seen"),
        F.max("event_ts").alias("batch_last_seen"),
        F.count(F.lit(1)).alias("total_events"),
        F.avg("moisture_pct").alias("avg_moisture_pct"),
        F.min("moisture_pct").alias("min_moisture_pct"),
        F.max("moisture_pct").alias("max_moisture_pct"),
        F.stddev_samp("moisture_pct").alias("stddev_moisture_pct"),
        F.avg("viscosity_cp").alias("avg_viscosity_cp"),
        F.avg("protein_pct").alias("avg_protein_pct"),
        F.avg("fat_pct").alias("avg_fat_pct"),
        in_spec.alias("moisture_in_spec_count"),
        case_count(F.col("moisture_quality") == F.lit("OUT_OF_SPEC")).alias("moisture_out_of_spec_count"),
        pct(in_spec, measured).alias("moisture_compliance_pct"),
        F.avg("temperature_c").alias("avg_process_temp_c"),
        F.avg("outlet_temperature_c").alias("avg_outlet_temp_c"),
        F.avg("pressure_kpa").alias("avg_pressure_kpa"),
        F.avg("powder_output_kg_h").alias("avg_powder_output_kg_h"),
        F.sum("energy_kwh").alias("total_energy_kwh"),
        F.sum("water_liters").alias("total_water_liters"),
        ftr.alias("ftr_pass_count"),
        qc.alias("quality_checks"),
        pct(ftr, qc).alias("ftr_rate_pct"),
        bool_count("is_alarm").alias("alarm_count"),
    ]


def batch_yield(silver: DataFrame, computed_at=None) -> DataFrame:
    """A2: per (batch, plant) over every event that names a batch."""
    return (silver.filter(F.col("batch_id").isNotNull())
            .groupBy(*BATCH_KEYS).agg(*_batch_aggs(), *_computed(computed_at)))


def sustainability_hourly(silver: DataFrame, co2_factor: float = C.CO2_KG_PER_KWH,
                          computed_at=None, approx_rsd: float | None = None) -> DataFrame:
    """A3: per plant x line x hour x date, all event types.

    ``approx_rsd`` switches the two distinct counts to estimates (exact by default)."""
    energy, water, powder = F.sum("energy_kwh"), F.sum("water_liters"), F.sum("powder_output_kg_h")
    return (silver.groupBy(*SUSTAINABILITY_KEYS, trunc_like(silver, "hour").alias("hour_bucket"), "event_date")
            .agg(F.count(F.lit(1)).alias("total_events"),
                 _distinct(F.col("equipment_id"), approx_rsd).alias("active_equipment_count"),
                 _distinct(F.col("batch_id"), approx_rsd).alias("batches_processed"),
                 energy.alias("total_energy_kwh"),
                 F.avg("energy_kwh").alias("avg_energy_kwh_per_event"),
                 water.alias("total_water_liters"),
                 F.sum("water_steam_liters").alias("total_steam_water_liters"),
                 F.sum("chemical_consumption_l").alias("total_chemical_liters"),
                 F.sum(F.when(F.col("equipment_type") == "cip_unit", F.col("water_liters"))
                       .otherwise(F.lit(0.0))).alias("cip_water_liters"),
                 F.sum(F.when(F.col("equipment_type") == "spray_dryer", F.col("water_steam_liters"))
                       .otherwise(F.lit(0.0))).alias("dryer_steam_liters"),
                 F.when(powder > 0, F.round(water / powder, 2)).alias("water_per_kg_powder_l"),
                 F.when(powder > 0, F.round(energy / powder, 3)).alias("energy_per_kg_powder_kwh"),
                 powder.alias("total_powder_output_kg"),
                 F.round(energy * F.lit(co2_factor), 2).alias("estimated_co2_kg"),
                 bool_count("is_alarm").alias("alarm_count"),
                 case_count(F.col("alarm_code") == "WATER_OVERCONSUMPTION").alias("water_alarm_count"),
                 case_count(F.col("alarm_code") == "MOISTURE_OUT_OF_SPEC").alias("moisture_alarm_count"),
                 *_computed(computed_at)))


# ---------------------------------------------------------------------------
# Mergeable partials: batch yield kept per (batch, plant, date) so an incremental
# refresh re-reads only the touched date partitions of silver, then merges the
# (small) partial rows of the touched batches.
# ---------------------------------------------------------------------------

_AVG_MEASURES = ("moisture_pct", "viscosity_cp", "protein_pct", "fat_pct", "temperature_c",
                 "outlet_temperature_c", "pressure_kpa", "powder_output_kg_h")


def batch_partials(silver: DataFrame) -> DataFrame:
    """Per (batch, plant, date) partial state for A2: sets, extremes, sums, counts, M2."""
    m = F.col("moisture_pct")
    aggs = [
        F.collect_set("equipment_id").alias("p_equipment_ids"),
        F.collect_set("equipment_type").alias("p_equipment_types"),
        F.collect_set("line_id").alias("p_line_ids"),
        F.min("event_ts").alias("p_first"), F.max("event_ts").alias("p_last"),
        F.count(F.lit(1)).alias("p_events"),
        F.min(m).alias("p_m_min"), F.max(m).alias("p_m_max"),
        (F.var_pop(m) * F.count(m)).alias("p_m_m2"),
        case_count(F.col("moisture_quality") == "IN_SPEC").alias("p_in_spec"),
        case_count(F.col("moisture_quality") == "OUT_OF_SPEC").alias("p_out_spec"),
        F.sum("energy_kwh").alias("p_energy"), F.sum("water_liters").alias("p_water"),
        bool_count("first_time_right").alias("p_ftr"), bool_count("is_quality_check").alias("p_qc"),
        bool_count("is_alarm").alias("p_alarm"),
    ]
    for c in _AVG_MEASURES:
        aggs += [F.sum(c).alias(f"p_sum_{c}"), F.count(c).alias(f"p_n_{c}")]
    return (silver.filter(F.col("batch_id").isNotNull())
            .groupBy(*BATCH_KEYS, "event_date").agg(*aggs))


def batch_yield_from_partials(partials: DataFrame, computed_at=None) -> DataFrame:
    """Merge daily partials into A2 rows (Chan's parallel variance for the stddev)."""
    def avg_of(c):
        return F.try_divide(F.sum(f"p_sum_{c}"), F.sum(f"p_n_{c}").cast("double"))

    # Chan et al.: M2 = sum(M2_i) + sum(n_i * (mean_i - mean)^2).  The group mean comes from a
    # window over the group's partial rows (one per day the batch spans, so bounded even for
    # a hot batch); the aggregate below reuses the window's partitioning.  This form does
    # not cancel catastrophically for a large mean with a small spread.
    group = Window.partitionBy(*BATCH_KEYS)
    p = partials.select(
        "*",
        F.try_divide(F.col("p_sum_moisture_pct"), F.col("p_n_moisture_pct").cast("double")).alias("p_m_mean"),
        F.try_divide(F.sum("p_sum_moisture_pct").over(group),
                     F.sum("p_n_moisture_pct").over(group).cast("double")).alias("g_m_mean"))
    n = F.sum("p_n_moisture_pct").cast("double")
    dev = F.col("p_m_mean") - F.col("g_m_mean")
    m2 = F.sum("p_m_m2") + F.coalesce(F.sum(F.col("p_n_moisture_pct") * dev * dev), F.lit(0.0))
    in_spec, measured = F.sum("p_in_spec"), F.sum("p_n_moisture_pct")
    ftr, qc = F.sum("p_ftr").cast("long"), F.sum("p_qc").cast("long")

    # sets of all days: one row per distinct member before they are collected, so the buffer is
    # the result's own size and not days x members
    def tagged(kind, c):
        return F.transform(c, lambda v: F.struct(F.lit(kind).alias("k"), v.alias("v")))

    kinds = {"equipment_ids": "p_equipment_ids", "equipment_types": "p_equipment_types", "line_ids": "p_line_ids"}
    member = F.flatten(F.array(*[tagged(k, c) for k, c in kinds.items()]))
    sets = (partials.select(*BATCH_KEYS, F.explode(member).alias("m")).select(*[F.col(k).alias(f"_{k}") for k in BATCH_KEYS], "m.k", "m.v").distinct()
            .groupBy(*[f"_{k}" for k in BATCH_KEYS]).agg(*[F.sort_array(F.collect_set(F.when(F.col("k") == k, F.col("v")))).alias(k) for k in kinds]))

    merged = (p.groupBy(*BATCH_KEYS).agg(
        F.min("p_first").alias("batch_first_seen"),
        F.max("p_last").alias("batch_last_seen"),
        F.sum("p_events").cast("long").alias("total_events"),
        avg_of("moisture_pct").alias("avg_moisture_pct"),
        F.min("p_m_min").alias("min_moisture_pct"),
        F.max("p_m_max").alias("max_moisture_pct"),
        F.when(n > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / (n - 1))).alias("stddev_moisture_pct"),
        avg_of("viscosity_cp").alias("avg_viscosity_cp"),
        avg_of("protein_pct").alias("avg_protein_pct"),
        avg_of("fat_pct").alias("avg_fat_pct"),
        in_spec.cast("long").alias("moisture_in_spec_count"),
        F.sum("p_out_spec").cast("long").alias("moisture_out_of_spec_count"),
        pct(in_spec, measured).alias("moisture_compliance_pct"),
        avg_of("temperature_c").alias("avg_process_temp_c"),
        avg_of("outlet_temperature_c").alias("avg_outlet_temp_c"),
        avg_of("pressure_kpa").alias("avg_pressure_kpa"),
        avg_of("powder_output_kg_h").alias("avg_powder_output_kg_h"),
        F.sum("p_energy").alias("total_energy_kwh"),
        F.sum("p_water").alias("total_water_liters"),
        ftr.alias("ftr_pass_count"),
        qc.alias("quality_checks"),
        pct(ftr, qc).alias("ftr_rate_pct"),
        F.sum("p_alarm").cast("long").alias("alarm_count")))
    same = [merged[k].eqNullSafe(sets[f"_{k}"]) for k in BATCH_KEYS]
    values = [F.col(c) for c in merged.columns if c not in BATCH_KEYS]
    return merged.join(sets, same, "left").select(
        *BATCH_KEYS, *[F.coalesce(F.col(k), F.array().cast("array<string>")).alias(k) for k in kinds], *values, *_computed(computed_at))
