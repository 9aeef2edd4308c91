"""P11, P12, T3 and the single-batch baseline as SQL with named parameters.

The texts are fixed; values only ever arrive as parameters, so an id that holds quotes, semicolons or comment marks is
compared like any other.  Results equal those of the DataFrame forms in ``serving``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .. import config as C

MACHINE_HISTORY = """
SELECT equipment_id, CAST(window_5min AS STRING) AS window_5min, avg_temperature_c, total_energy_kwh,
       CAST(alarm_count AS INT) AS alarm_count, avg_flow_rate_l_min
FROM {gold}
WHERE equipment_id = :equipment_id AND window_5min >= :since AND event_date >= TO_DATE(:since)
ORDER BY window_5min
"""

NEWEST_OF_BATCH = """
SELECT event_id, event_ts, event_type, equipment_id, batch_id, temperature_c, moisture_pct, alarm_code
FROM {silver}
WHERE batch_id = :batch_id AND event_ts >= :since AND event_date >= TO_DATE(:since)
ORDER BY event_ts DESC, event_id DESC
LIMIT :rows
"""

BATCH_BASELINE = """
SELECT batch_id, plant_id, avg_viscosity_cp, avg_protein_pct, avg_fat_pct, ftr_rate_pct, total_energy_kwh
FROM {batches}
WHERE batch_id = :batch_id
ORDER BY plant_id
"""


def machine_history(spark: SparkSession, gold_eq: DataFrame, equipment_id: str, as_of: dt.datetime, hours: int = 1) -> DataFrame:
    """One machine's windows of the last ``hours``, oldest first."""
    return spark.sql(MACHINE_HISTORY, args={"equipment_id": equipment_id, "since": as_of - dt.timedelta(hours=hours)}, gold=gold_eq)


def newest_of_batch(spark: SparkSession, silver: DataFrame, batch_id: str, as_of: dt.datetime, hours: int = 24, rows: int = C.POLL_LIMIT) -> DataFrame:
    """One batch's newest events of the last ``hours``, newest first."""
    return spark.sql(NEWEST_OF_BATCH, args={"batch_id": batch_id, "since": as_of - dt.timedelta(hours=hours), "rows": rows}, silver=silver)


def batch_baseline(spark: SparkSession, gold_batch: DataFrame, batch_id: str) -> DataFrame:
    """The baseline rows that a what-if request for one batch starts from."""
    return spark.sql(BATCH_BASELINE, args={"batch_id": batch_id}, batches=gold_batch)
