"""Stand-in input: the driver's generic tables mapped onto the sensor schema.

The test data has no sensor columns, so ``events`` is projected onto the 31 raw
event columns and ``supplier`` onto the equipment registry.  This is one narrow
projection per row (no joins, no aggregation) and only *produces input*: every
operator downstream does its own work on it and would do the same on real sensor
files of this schema.  The mapping rules are fixed test-fixture values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENT_SCHEMA

# --- fixed values: fixture mapping ---------------------------------------
EVENT_TYPE_MAP = (("error", "alarm"), ("purchase", "quality_check"), ("signup", "batch_start"))
EQUIPMENT_TYPE_BY_MOD5 = ("spray_dryer", "mixer", "heat_exchanger", "cip_unit", "packing")
LINE_BY_MOD3 = ("LINE-A", "LINE-B", "LINE-C")
ALARM_CODE_BY_TYPE = (("spray_dryer", "MOISTURE_OUT_OF_SPEC"), ("mixer", "VISCOSITY_OUT_OF_RANGE"),
                      ("cip_unit", "WATER_OVERCONSUMPTION"))
BATCH_COUNT = 15
REPEAT_OFFSET = 1_500_000_000  # a multiple of BATCH_COUNT: a repeat names the same batch


def _pick(index: Column, values) -> Column:
    out = None
    for i, v in enumerate(values):
        out = (F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v)))
    return out


def _null(name: str) -> Column:
    return F.lit(None).cast(EVENT_SCHEMA[name].dataType).alias(name)


def sensor_events(events: DataFrame) -> DataFrame:
    """Driver ``events`` -> raw sensor events (``event_ts`` stays TIMESTAMP_NTZ)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    et = F.col("event_type")
    mapped_type = F.coalesce(
        *[F.when(et == src, F.lit(dst)) for src, dst in EVENT_TYPE_MAP], F.lit("sensor_reading"))
    uid = F.col("user_id")
    eq_type = _pick(uid % 5, EQUIPMENT_TYPE_BY_MOD5)
    typed = events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("event_ts"),
        mapped_type.alias("event_type"),
        F.concat(F.lit("EQ-"), uid.cast("string")).alias("equipment_id"),
        F.concat(F.lit("Machine "), uid.cast("string")).alias("equipment_name"),
        eq_type.alias("equipment_type"),
        _pick(uid % 3, LINE_BY_MOD3).alias("line_id"),
        F.when(uid % 3 == 2, F.lit("PLANT-2")).otherwise(F.lit("PLANT-1")).alias("plant_id"),
        F.when(k % 10 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("BATCH-"), (F.col("event_id") % BATCH_COUNT).cast("string")))
         .alias("batch_id"),
        k.alias("_k"),
        F.col("value").alias("_v"),
    )
    kk, v = F.col("_k"), F.col("_v")
    t, ty = F.col("event_type"), F.col("equipment_type")
    not_start = t != F.lit("batch_start")
    dryer_or_hx = ty.isin("spray_dryer", "heat_exchanger")
    qc = t == F.lit("quality_check")
    consumes = not_start & ~qc
    bio = (qc | (ty == F.lit("mixer"))) & not_start
    dryer = ty == F.lit("spray_dryer")
    cip = ty == F.lit("cip_unit")
    alarm = t == F.lit("alarm")
    alarm_code = F.coalesce(*[F.when(ty == src, F.lit(c)) for src, c in ALARM_CODE_BY_TYPE], F.lit("OTHER"))
    cols = {
        "temperature_c": F.when(not_start, F.lit(60.0) + kk * F.lit(0.5)),
        "inlet_temperature_c": F.when(not_start & dryer_or_hx, F.lit(180.0) + kk * F.lit(0.3)),
        "outlet_temperature_c": F.when(not_start & dryer_or_hx, F.lit(60.0) + kk * F.lit(0.3)),
        "pressure_kpa": F.when(not_start, F.lit(100.0) + kk),
        "flow_rate_l_min": F.when(not_start, F.lit(80.0) + kk),
        "moisture_pct": F.when((qc | dryer) & not_start, F.lit(2.0) + kk / F.lit(25.0)),
        "viscosity_cp": F.when(bio, F.lit(600.0) + kk * F.lit(5.0)),
        "protein_pct": F.when(bio, F.lit(30.0) + kk / F.lit(20.0)),
        "fat_pct": F.when(bio, F.lit(24.0) + kk / F.lit(25.0)),
        "first_time_right": F.when(qc, kk > 5),
        "energy_kwh": F.when(consumes, v),
        "water_liters": F.when(consumes, F.when(cip, v * F.lit(20.0)).otherwise(v)),
        "water_steam_liters": F.when(consumes & dryer, v * F.lit(2.0)),
        "powder_output_kg_h": F.when(consumes & dryer, F.lit(1700.0) + kk * F.lit(2.0)),
        "chemical_consumption_l": F.when(consumes & cip, kk / F.lit(10.0)),
        "alarm_code": F.when(alarm, alarm_code),
        "alarm_severity": F.when(alarm, F.when(kk >= 90, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))),
    }
    out = []
    for f in EVENT_SCHEMA.fields:
        if f.name in typed.columns and not f.name.startswith("_"):
            out.append(F.col(f.name))
        elif f.name in cols:
            out.append(cols[f.name].cast(f.dataType).alias(f.name))
        else:
            out.append(_null(f.name))
    return typed.select(*out)


def busy_events(events: DataFrame, speed: int = 1440) -> DataFrame:
    """Driver ``events`` as a busy half hour: a day's events within a minute, every tenth event sent twice (under another
    number), one in 97 without a time.  All rows stay; limits, recency filters, repeats and the null guard then
    bind."""
    first = events.select(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    timed = events.select("*", (F.unix_micros(F.col("ts").cast("timestamp")) - first).alias("_after"), first.alias("_first"))
    squeezed = timed.withColumn("ts", F.expr(f"CASE WHEN event_id % 97 <> 5 THEN CAST(timestamp_micros(_first + _after div {speed}) AS TIMESTAMP_NTZ) END"))
    squeezed = squeezed.select(*events.columns)
    again = squeezed.where("event_id % 10 = 3").withColumn("event_id", F.col("event_id") + REPEAT_OFFSET)
    return squeezed.unionByName(again)


def equipment_registry(supplier: DataFrame) -> DataFrame:
    """Driver ``supplier`` -> equipment registry (same modulo rules as the events)."""
    sk = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("EQ-"), sk.cast("string")).alias("equipment_id"),
        F.col("s_name").alias("name"),
        _pick(sk % 5, EQUIPMENT_TYPE_BY_MOD5).alias("type"),
        _pick(sk % 3, LINE_BY_MOD3).alias("line_id"),
        F.when(sk % 3 == 2, F.lit("PLANT-2")).otherwise(F.lit("PLANT-1")).alias("plant_id"),
        F.lit(None).cast("int").alias("capacity_kg_h"),
        F.lit(None).cast("int").alias("commissioned_year"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_events(read_table(spark, sf_dir, "events"))


def load_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return equipment_registry(read_table(spark, sf_dir, "supplier"))
