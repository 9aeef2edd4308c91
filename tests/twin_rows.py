"""Row builders and table folders that the tests share."""

from __future__ import annotations

import datetime as dt

from sensortwin.schemas import EVENT_SCHEMA

SF_SMALL = "/root/testdata/sf0.001"
SF_MEDIUM = "/root/testdata/sf0.01"


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def make_raw(spark, rows: list[dict]):
    """Raw typed events (``event_ts`` TIMESTAMP) from partial dicts; missing fields are NULL."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField(f.name, T.TimestampType() if f.name == "event_ts" else f.dataType)
                           for f in EVENT_SCHEMA.fields])
    full = []
    for i, r in enumerate(rows):
        d = {f.name: None for f in schema.fields}
        d.update({"event_id": f"e{i}", "event_type": "sensor_reading", "equipment_id": "EQ-1",
                  "equipment_name": "M1", "equipment_type": "spray_dryer", "line_id": "LINE-A",
                  "plant_id": "PLANT-1", "event_ts": ts("2024-01-01T00:00:00")})
        d.update(r)
        full.append(tuple(d[f.name] for f in schema.fields))
    return spark.createDataFrame(full, schema)
