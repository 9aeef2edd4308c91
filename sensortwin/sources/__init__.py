"""Sources and sinks: JSON landing files, CSV dimensions, parquet tables, test adapter."""

from .adapter import equipment_registry, load_events, load_registry, read_table, sensor_events
from .events import (read_events_batch, read_events_stream, replay_to_landing, split_corrupt,
                     to_landing_json, with_ingest_metadata)
from .reference import (batches_reference, create_namespace, load_reference, peek, read_batches_csv,
                        read_equipment_csv, read_reference_csv, row_count, write_table)

__all__ = [
    "equipment_registry", "load_events", "load_registry", "read_table", "sensor_events",
    "read_events_batch", "read_events_stream", "replay_to_landing", "split_corrupt",
    "to_landing_json", "with_ingest_metadata", "batches_reference", "create_namespace",
    "load_reference", "peek", "read_batches_csv", "read_equipment_csv", "read_reference_csv",
    "row_count", "write_table",
]
