"""Bronze and silver layers (P1-P8): row-local, no shuffle.

Both are pure ``DataFrame -> DataFrame`` functions shared by the batch path and the
streaming path, so a stream produces exactly the rows a batch run would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import (classify_energy, classify_moisture, is_alarm, is_batch_lifecycle,
                         is_quality_check, trunc_like)
from ..schemas import EVENT_SCHEMA, INGEST_COLUMNS


def to_bronze(raw: DataFrame) -> DataFrame:
    """Typed projection of the 31 raw columns (plus ingest metadata when present).

    ``try_cast`` (ANSI is on: a plain cast of a bad value fails the whole query).
    ``event_ts`` text is parsed to TIMESTAMP; an already typed timestamp is kept.
    """
    cols = []
    for f in EVENT_SCHEMA.fields:
        c = F.col(f.name)
        have = raw.schema[f.name].dataType
        if f.name == "event_ts":
            if isinstance(have, (T.TimestampType, T.TimestampNTZType)):
                cols.append(c)
            else:
                cols.append(c.try_cast("timestamp").alias("event_ts"))
        elif have == f.dataType:
            cols.append(c)
        else:
            cols.append(c.try_cast(f.dataType).alias(f.name))
    cols += [F.col(m) for m in INGEST_COLUMNS if m in raw.columns]
    return raw.select(*cols)


def to_silver(bronze: DataFrame) -> DataFrame:
    """Null guard, time parts, event-class flags, moisture and energy classes."""
    b = bronze.filter(F.col("event_id").isNotNull() & F.col("event_ts").isNotNull())
    head = ["event_id", "event_ts", "event_type", "equipment_id", "equipment_name",
            "equipment_type", "line_id", "plant_id", "batch_id"]
    measures = ["temperature_c", "inlet_temperature_c", "outlet_temperature_c", "pressure_kpa",
                "flow_rate_l_min", "mixing_speed_rpm", "air_flow_m3_h", "powder_output_kg_h",
                "packing_speed_cans_min", "reject_rate_pct", "moisture_pct", "viscosity_cp",
                "protein_pct", "fat_pct", "first_time_right", "energy_kwh", "water_liters",
                "water_steam_liters", "chemical_consumption_l", "alarm_code", "alarm_severity",
                "cip_phase"]
    return b.select(
        *head,
        F.to_date("event_ts").alias("event_date"),
        F.hour("event_ts").alias("event_hour"),
        trunc_like(b, "hour").alias("event_hour_ts"),
        trunc_like(b, "minute").alias("event_minute_ts"),
        *measures,
        is_alarm().alias("is_alarm"),
        is_quality_check().alias("is_quality_check"),
        is_batch_lifecycle().alias("is_batch_lifecycle"),
        classify_moisture().alias("moisture_quality"),
        classify_energy().alias("energy_intensity"),
        *[m for m in INGEST_COLUMNS if m in b.columns],
    )
