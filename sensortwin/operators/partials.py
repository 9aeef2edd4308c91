"""Mergeable partial states of the gold aggregates (A1-A3): what a micro-batch adds to a gold table.

A partial row holds sums, counts, extremes, small sets and sketches per gold key.  Partials of any slices of
the events, in any order, merge to the partials of all of them (``merge_*``), from which the gold rows
follow (``*_from_partials``).  Grouping keys come first, so a filter on the window or the date passes through
the merge down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import bool_count, bucket_start, case_count, pct, trunc_like
from .gold import BATCH_KEYS, EQUIPMENT_KEYS, SUSTAINABILITY_KEYS, _AVG_MEASURES

WINDOW_KEYS = (*EQUIPMENT_KEYS, "window_5min", "event_date")
HOUR_KEYS = (*SUSTAINABILITY_KEYS, "hour_bucket", "event_date")
#: log2 of the sketch's buckets: a relative standard error of about 1.04 / sqrt(2^12) = 1.6 %.
SKETCH_LG_K = 12
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LG_K / 2)

_EQ_AVG = {"temperature_c": "avg_temperature_c", "inlet_temperature_c": "avg_inlet_temp_c", "outlet_temperature_c": "avg_outlet_temp_c",
           "pressure_kpa": "avg_pressure_kpa", "flow_rate_l_min": "avg_flow_rate_l_min", "energy_kwh": "avg_energy_kwh",
           "moisture_pct": "avg_moisture_pct", "viscosity_cp": "avg_viscosity_cp", "protein_pct": "avg_protein_pct",
           "fat_pct": "avg_fat_pct", "powder_output_kg_h": "avg_powder_output_kg_h"}
_SUS_SUMS = ("energy_kwh", "water_liters", "water_steam_liters", "chemical_consumption_l", "powder_output_kg_h")


def _stamp(computed_at) -> Column:
    return (F.current_timestamp() if computed_at is None else F.lit(computed_at).cast("timestamp")).alias("p_computed_at")


def _merged(p: DataFrame, keys, how: dict[str, tuple[str, ...]]) -> DataFrame:
    """One row per key: columns summed, their least or greatest value, sets and sketches united."""
    ways = {"sum": F.sum, "min": F.min, "max": F.max, "sketch": lambda c: F.hll_union_agg(c, F.lit(False)),
            "set": lambda c: F.array_distinct(F.flatten(F.collect_list(c)))}
    way_of = {c: ways[way] for way, cols in how.items() for c in cols}
    types = {f.name: f.dataType for f in p.schema.fields}
    return p.groupBy(*keys).agg(*[way_of[c](c).cast(types[c]).alias(c) for c in p.columns if c not in keys])


def _avg(total: str, n: str) -> Column:
    return F.try_divide(F.col(total), F.col(n).cast("double"))


def _computed_at(wanted: bool) -> list[Column]:
    return [F.col("p_computed_at").alias("_computed_at")] if wanted else []


# -- A1 -------------------------------------------------------------------------------------------
def equipment_partials(silver: DataFrame, window: str = C.EQUIPMENT_WINDOW, computed_at=None) -> DataFrame:
    """Per machine identity x 5-minute window: the state of A1, with the alarm types as a set (bounded by the alarm
    vocabulary) and as a sketch."""
    alarm = F.when(F.col("is_alarm"), F.col("alarm_code"))
    aggs = [F.count(F.lit(1)).alias("p_events"), F.min("temperature_c").alias("p_t_min"), F.max("temperature_c").alias("p_t_max"),
            F.max("pressure_kpa").alias("p_pressure_max"), F.sum("water_liters").alias("p_water"), F.sum("water_steam_liters").alias("p_steam"),
            bool_count("is_alarm").alias("p_alarm"), bool_count("first_time_right").alias("p_ftr"), bool_count("is_quality_check").alias("p_qc"),
            F.collect_set(alarm).alias("p_alarm_types"), F.hll_sketch_agg(alarm, F.lit(SKETCH_LG_K)).alias("p_alarm_sketch")]
    for c in _EQ_AVG:
        aggs += [F.sum(c).alias(f"p_sum_{c}"), F.count(c).alias(f"p_n_{c}")]
    s = silver.filter(F.col("event_type").isin(*C.MEASURED_EVENT_TYPES))
    return s.groupBy(*EQUIPMENT_KEYS, bucket_start("event_ts", window).alias("window_5min"), "event_date").agg(*aggs, _stamp(computed_at))


def merge_equipment_partials(p: DataFrame) -> DataFrame:
    return _merged(p, WINDOW_KEYS, {
        "sum": ("p_events", "p_water", "p_steam", "p_alarm", "p_ftr", "p_qc", *[f"p_{k}_{c}" for c in _EQ_AVG for k in ("sum", "n")]),
        "min": ("p_t_min",), "max": ("p_t_max", "p_pressure_max", "p_computed_at"), "set": ("p_alarm_types",), "sketch": ("p_alarm_sketch",)})


def equipment_from_partials(p: DataFrame, computed_at: bool = False) -> DataFrame:
    """A1 rows of merged partials."""
    avg = {name: _avg(f"p_sum_{c}", f"p_n_{c}").alias(name) for c, name in _EQ_AVG.items()}
    ftr, qc = F.col("p_ftr"), F.col("p_qc")
    return p.select(
        *WINDOW_KEYS, F.col("p_events").alias("event_count"), avg["avg_temperature_c"], F.col("p_t_min").alias("min_temperature_c"),
        F.col("p_t_max").alias("max_temperature_c"), avg["avg_inlet_temp_c"], avg["avg_outlet_temp_c"], avg["avg_pressure_kpa"],
        F.col("p_pressure_max").alias("max_pressure_kpa"), avg["avg_flow_rate_l_min"], F.col("p_sum_energy_kwh").alias("total_energy_kwh"),
        F.col("p_water").alias("total_water_liters"), F.col("p_steam").alias("total_steam_liters"), avg["avg_energy_kwh"],
        avg["avg_moisture_pct"], avg["avg_viscosity_cp"], avg["avg_protein_pct"], avg["avg_fat_pct"], avg["avg_powder_output_kg_h"],
        F.col("p_alarm").alias("alarm_count"), F.size("p_alarm_types").cast("long").alias("distinct_alarm_types"),
        ftr.alias("ftr_pass_count"), qc.alias("quality_check_count"), F.when(qc > 0, pct(ftr, qc)).alias("ftr_rate_pct"), *_computed_at(computed_at))


# -- A3 -------------------------------------------------------------------------------------------
def sustainability_partials(silver: DataFrame, computed_at=None) -> DataFrame:
    """Per plant x line x hour: the state of A3 but for its distinct counts, which are here as sketches and exactly
    in :func:`sustainability_members`."""
    cip, dryer = F.col("equipment_type") == "cip_unit", F.col("equipment_type") == "spray_dryer"
    aggs = [F.count(F.lit(1)).alias("p_events"), F.count("energy_kwh").alias("p_n_energy_kwh"),
            F.sum(F.when(cip, F.col("water_liters")).otherwise(F.lit(0.0))).alias("p_cip_water"),
            F.sum(F.when(dryer, F.col("water_steam_liters")).otherwise(F.lit(0.0))).alias("p_dryer_steam"),
            bool_count("is_alarm").alias("p_alarm"), case_count(F.col("alarm_code") == "WATER_OVERCONSUMPTION").alias("p_water_alarm"),
            case_count(F.col("alarm_code") == "MOISTURE_OUT_OF_SPEC").alias("p_moisture_alarm"),
            F.hll_sketch_agg("equipment_id", F.lit(SKETCH_LG_K)).alias("p_equipment_sketch"),
            F.hll_sketch_agg("batch_id", F.lit(SKETCH_LG_K)).alias("p_batch_sketch")]
    aggs += [F.sum(c).alias(f"p_sum_{c}") for c in _SUS_SUMS]
    return silver.groupBy(*SUSTAINABILITY_KEYS, trunc_like(silver, "hour").alias("hour_bucket"), "event_date").agg(*aggs, _stamp(computed_at))


def merge_sustainability_partials(p: DataFrame) -> DataFrame:
    return _merged(p, HOUR_KEYS, {
        "sum": ("p_events", "p_n_energy_kwh", "p_cip_water", "p_dryer_steam", "p_alarm", "p_water_alarm", "p_moisture_alarm",
                *[f"p_sum_{c}" for c in _SUS_SUMS]),
        "max": ("p_computed_at",), "sketch": ("p_equipment_sketch", "p_batch_sketch")})


def sustainability_members(silver: DataFrame) -> DataFrame:
    """The exact sets behind A3's distinct counts, a row per member: (hour key, kind, member)."""
    hour = trunc_like(silver, "hour").alias("hour_bucket")
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("member")) for kind, c in (("equipment", "equipment_id"), ("batch", "batch_id"))])
    return (silver.select(*SUSTAINABILITY_KEYS, hour, "event_date", F.explode(kinds).alias("m")).where("m.member IS NOT NULL")
            .select(*HOUR_KEYS, "m.kind", "m.member").distinct())


def merge_members(members: DataFrame) -> DataFrame:
    return members.distinct()


def sustainability_from_partials(p: DataFrame, members: DataFrame, co2_factor: float = C.CO2_KG_PER_KWH, computed_at: bool = False) -> DataFrame:
    """A3 rows of merged partials and merged members.

    Both sides are reduced to the hour key before they meet: they are one union and one more aggregate, which also holds
    null keys together."""
    counted = members.groupBy(*HOUR_KEYS).agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(name) for kind, name in
                                                (("equipment", "n_equipment"), ("batch", "n_batches"))])
    values = [c for c in p.columns if c not in HOUR_KEYS and "sketch" not in c]
    both = p.select(*HOUR_KEYS, *values).unionByName(counted, allowMissingColumns=True)
    one = both.groupBy(*HOUR_KEYS).agg(*[F.max(c).alias(c) for c in (*values, "n_equipment", "n_batches")])
    energy, water, powder = F.col("p_sum_energy_kwh"), F.col("p_sum_water_liters"), F.col("p_sum_powder_output_kg_h")
    return one.select(
        *HOUR_KEYS, F.col("p_events").alias("total_events"), F.coalesce("n_equipment", F.lit(0)).cast("long").alias("active_equipment_count"),
        F.coalesce("n_batches", F.lit(0)).cast("long").alias("batches_processed"), energy.alias("total_energy_kwh"),
        _avg("p_sum_energy_kwh", "p_n_energy_kwh").alias("avg_energy_kwh_per_event"), water.alias("total_water_liters"),
        F.col("p_sum_water_steam_liters").alias("total_steam_water_liters"), F.col("p_sum_chemical_consumption_l").alias("total_chemical_liters"),
        F.col("p_cip_water").alias("cip_water_liters"), F.col("p_dryer_steam").alias("dryer_steam_liters"),
        F.when(powder > 0, F.round(water / powder, 2)).alias("water_per_kg_powder_l"),
        F.when(powder > 0, F.round(energy / powder, 3)).alias("energy_per_kg_powder_kwh"), powder.alias("total_powder_output_kg"),
        F.round(energy * F.lit(co2_factor), 2).alias("estimated_co2_kg"), F.col("p_alarm").alias("alarm_count"),
        F.col("p_water_alarm").alias("water_alarm_count"), F.col("p_moisture_alarm").alias("moisture_alarm_count"), *_computed_at(computed_at))


def distinct_estimates(p: DataFrame, *keys: str) -> DataFrame:
    """Distinct machines and batches by ``keys`` (hour keys or fewer, such as plant and day) from the sketches alone:
    hours merge to days without their events, where exact counts would need the members again."""
    return p.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("p_equipment_sketch", F.lit(False))).alias("equipment_estimate"),
                                F.hll_sketch_estimate(F.hll_union_agg("p_batch_sketch", F.lit(False))).alias("batch_estimate"))


# -- A2 -------------------------------------------------------------------------------------------
def merge_batch_partials(p: DataFrame) -> DataFrame:
    """One row per (batch, plant, day); the sums of squares are joined by Chan's formula around the group's mean."""
    keys = (*BATCH_KEYS, "event_date")
    group = Window.partitionBy(*keys)  # the unmerged rows of one key: a few per micro-batch
    mean = F.try_divide(F.col("p_sum_moisture_pct"), F.col("p_n_moisture_pct").cast("double"))
    whole = F.try_divide(F.sum("p_sum_moisture_pct").over(group), F.sum("p_n_moisture_pct").over(group).cast("double"))
    around = F.col("p_n_moisture_pct") * (mean - whole) * (mean - whole)
    shifted = p.withColumn("p_m_m2", F.when(F.col("p_m_m2").isNotNull(), F.col("p_m_m2") + F.coalesce(around, F.lit(0.0))))
    return _merged(shifted, keys, {
        "sum": ("p_events", "p_m_m2", "p_in_spec", "p_out_spec", "p_energy", "p_water", "p_ftr", "p_qc", "p_alarm",
                *[f"p_{k}_{c}" for c in _AVG_MEASURES for k in ("sum", "n")]),
        "min": ("p_first", "p_m_min"), "max": ("p_last", "p_m_max"), "set": ("p_equipment_ids", "p_equipment_types", "p_line_ids")})


# -- alarms ---------------------------------------------------------------------------------------
def first_alarms(silver: DataFrame) -> DataFrame:
    """The earliest alarm of each machine in a slice of events; equal times go to the smallest event id."""
    rest = ("event_ts", "event_id", "equipment_name", "equipment_type", "line_id", "plant_id", "alarm_code", "alarm_severity")
    return merge_first_alarms(silver.filter(F.col("is_alarm")).select("equipment_id", *rest))


def merge_first_alarms(alarms: DataFrame) -> DataFrame:
    rest = [c for c in alarms.columns if c != "equipment_id"]
    first = alarms.groupBy("equipment_id").agg(F.min_by(F.struct(*rest), F.struct("event_ts", "event_id")).alias("_a"))
    return first.select("equipment_id", *[F.col(f"_a.{c}").alias(c) for c in rest])
