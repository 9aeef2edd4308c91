"""Explicit schemas: no inference anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING_FIELDS_HEAD = (
    "event_id", "event_ts", "event_type", "equipment_id", "equipment_name",
    "equipment_type", "line_id", "plant_id", "batch_id",
)
MEASURE_FIELDS = (
    "temperature_c", "inlet_temperature_c", "outlet_temperature_c", "pressure_kpa",
    "flow_rate_l_min", "mixing_speed_rpm", "air_flow_m3_h", "powder_output_kg_h",
    "packing_speed_cans_min", "reject_rate_pct",
    "moisture_pct", "viscosity_cp", "protein_pct", "fat_pct",
)
SUSTAINABILITY_FIELDS = ("energy_kwh", "water_liters", "water_steam_liters", "chemical_consumption_l")
_STRING_FIELDS_TAIL = ("alarm_code", "alarm_severity", "cip_phase")

# The 31 hinted columns of a raw sensor event, in file order.  ``event_ts`` is read
# as a string and parsed by ``to_bronze`` so a bad timestamp nulls one field, not the row.
EVENT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _STRING_FIELDS_HEAD]
    + [T.StructField(n, T.DoubleType()) for n in MEASURE_FIELDS]
    + [T.StructField("first_time_right", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in SUSTAINABILITY_FIELDS]
    + [T.StructField(n, T.StringType()) for n in _STRING_FIELDS_TAIL]
)
EVENT_COLUMNS = tuple(f.name for f in EVENT_SCHEMA.fields)

CORRUPT_COLUMN = "_corrupt_record"
EVENT_SCHEMA_WITH_CORRUPT = T.StructType(
    EVENT_SCHEMA.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())]
)

INGEST_COLUMNS = ("_ingested_at", "_source_file", "_file_modified_at")

EQUIPMENT_SCHEMA = T.StructType([
    T.StructField("equipment_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("line_id", T.StringType()),
    T.StructField("plant_id", T.StringType()),
    T.StructField("capacity_kg_h", T.IntegerType()),
    T.StructField("commissioned_year", T.IntegerType()),
])

RAW_MATERIAL_BATCH_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("plant_id", T.StringType()),
    T.StructField("milk_origin", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("protein_pct", T.DoubleType()),
    T.StructField("fat_pct", T.DoubleType()),
    T.StructField("lactose_pct", T.DoubleType()),
    T.StructField("moisture_pct", T.DoubleType()),
    T.StructField("viscosity_cp", T.IntegerType()),
    T.StructField("volume_liters", T.IntegerType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("supplier_id", T.StringType()),
    T.StructField("quality_grade", T.StringType()),
])

SCENARIO_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("fat_delta_pct", T.DoubleType()),
    T.StructField("protein_delta_pct", T.DoubleType()),
    T.StructField("heat_setting_c", T.DoubleType()),
])
