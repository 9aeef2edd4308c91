"""Alarm rules and alert feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .serving import latest_window


def detect_alarms(readings: DataFrame,
                  dryer_moisture=C.DRYER_MOISTURE_LIMITS, dryer_center: float = C.DRYER_MOISTURE_CENTER,
                  dryer_high_dev: float = C.DRYER_HIGH_DEVIATION, mixer_viscosity=C.MIXER_VISCOSITY_LIMITS,
                  cip_water: float = C.CIP_WATER_LIMIT) -> DataFrame:
    """K1: apply the sensor alarm rules to raw readings.

    A ``sensor_reading`` breaching a rule becomes ``event_type='alarm'`` with its code and
    severity; other rows pass through unchanged.  Adds ``rule_fired`` (boolean).
    Rules: dryer moisture outside [3, 5] (HIGH when |m - 4| > 1.5, else MEDIUM);
    mixer viscosity outside [650, 1050]; CIP water above 4500 (both MEDIUM).
    """
    ty, m = F.col("equipment_type"), F.col("moisture_pct")
    v, w = F.col("viscosity_cp"), F.col("water_liters")
    reading = F.col("event_type") == F.lit("sensor_reading")
    dryer = reading & (ty == "spray_dryer") & ((m > dryer_moisture[1]) | (m < dryer_moisture[0]))
    mixer = reading & (ty == "mixer") & ((v > mixer_viscosity[1]) | (v < mixer_viscosity[0]))
    cip = reading & (ty == "cip_unit") & (w > cip_water)
    code = (F.when(dryer, F.lit("MOISTURE_OUT_OF_SPEC")).when(mixer, F.lit("VISCOSITY_OUT_OF_RANGE"))
            .when(cip, F.lit("WATER_OVERCONSUMPTION")))
    severity = (F.when(dryer, F.when(F.abs(m - dryer_center) > dryer_high_dev, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
                .when(mixer | cip, F.lit("MEDIUM")))
    fired = F.coalesce(dryer | mixer | cip, F.lit(False))
    return readings.select(
        *[F.when(fired, F.lit("alarm")).otherwise(F.col(c)).alias(c) if c == "event_type"
          else F.when(fired, code).otherwise(F.col(c)).alias(c) if c == "alarm_code"
          else F.when(fired, severity).otherwise(F.col(c)).alias(c) if c == "alarm_severity"
          else F.col(c) for c in readings.columns],
        fired.alias("rule_fired"))


def _severity(alarm_count):
    return F.when(alarm_count >= C.CRITICAL_ALARM_COUNT, F.lit("critical")).otherwise(F.lit("warning"))


# --- fixed values: alert texts -------------------------------------------
ALERT_TITLE = "%s Alert — %s"
ALERT_META = "%s · Line %s · Plant %s"
CRITICAL_MESSAGE = "%s active alarms detected. Current temp %s°C — thermal runaway risk. Inspect immediately."


def alert_columns(df: DataFrame) -> DataFrame:
    """Severity by the alarm count, and the texts of an alert.  Only critical alerts have a message made of data
    (the predictive one names a random number of hours); an unknown temperature leaves its place empty."""
    df = df.withColumn("severity", _severity(F.col("alarm_count")))
    crit = F.col("severity") == "critical"
    degrees = F.coalesce(F.round("avg_temperature_c", 1).cast("decimal(18,1)").cast("string"), F.lit(""))
    return df.select(
        "*",
        F.format_string(ALERT_TITLE, F.when(crit, "Critical").otherwise("Predictive"), F.col("equipment_name")).alias("title"),
        F.when(crit, F.format_string(CRITICAL_MESSAGE, F.col("alarm_count").cast("string"), degrees)).alias("message"),
        F.format_string(ALERT_META, F.col("equipment_type"), F.col("line_id"), F.col("plant_id")).alias("meta"))


def alerts(gold_eq: DataFrame, partitioned: bool = False) -> DataFrame:
    """K2: one alert per machine with alarms in the latest window; critical at >= 3."""
    w = latest_window(gold_eq, partitioned).filter(F.col("alarm_count") > 0)
    picked = w.groupBy("equipment_id").agg(
        F.min_by(F.struct("equipment_name", "equipment_type", "line_id", "plant_id", "alarm_count",
                          "avg_temperature_c", "window_5min"),
                 F.struct("equipment_name", "equipment_type", "line_id", "plant_id")).alias("_a"))
    a = picked.select("equipment_id", "_a.*")
    return alert_columns(a)


def alert_history(gold_eq: DataFrame) -> DataFrame:
    """The first alert each machine ever raised: its earliest window with an alarm.

    ``min_by`` in a grouped aggregate (partial per input partition), so a machine with
    a huge history is reduced map-side rather than sorted in one task.
    """
    w = gold_eq.filter(F.col("alarm_count") > 0)
    first = w.groupBy("equipment_id").agg(
        F.min_by(F.struct("window_5min", "equipment_name", "equipment_type", "line_id", "plant_id",
                          "alarm_count", "avg_temperature_c"),
                 F.struct("window_5min", "equipment_name", "equipment_type", "line_id", "plant_id")).alias("_a"))
    a = first.select("equipment_id", "_a.*")
    return alert_columns(a)
