"""Live views over the event streams, each kept in a table that a reader can take at any time.

* :func:`equipment_metrics_stream`: A1 with a watermark, in update mode (X5's bounded-state form);
* :func:`event_rate_stream`: A11 as two chained stateful operators, in append mode;
* :func:`feed_buffer`: the newest events of the live feed (X6, T8), a bounded top-k;
* :func:`first_alarm_table` and :func:`alert_board`: the first alarm of each machine (X7, K2);
* :func:`clustered_table`: events laid out by plant and type with Bloom filters (S8, S9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config as C
from ..functions import bucket_start
from ..operators import partials as P
from ..operators.alarms import alert_columns
from ..operators.gold import EQUIPMENT_KEYS, equipment_aggs
from ..operators.serving import DEDUP_KEYS, LIVE_COLUMNS, live_projection
from .deltas import DeltaTable


def append_to(table_of):
    """The ``foreachBatch`` function that appends every micro-batch to ``table_of(spark)``, by way of its second
    item where that is a (table, partial) pair."""
    def run(batch_df: DataFrame, epoch: int) -> None:
        table, partial = table_of(batch_df.sparkSession)
        table.append(partial(batch_df), epoch)
    return run


# -- A1 with a watermark ------------------------------------------------------------------------
def equipment_metrics_stream(silver: DataFrame, delay: str = "10 minutes", window: str = C.EQUIPMENT_WINDOW) -> DataFrame:
    """A1 on a stream for update mode: state of a 5-minute window ends ``delay`` after it, and events later than
    that are dropped (Spark counts them in ``numRowsDroppedByWatermark``).  Where every event must count, however
    late, use the deltas of ``start_gold``."""
    s = silver.filter(F.col("event_type").isin(*C.MEASURED_EVENT_TYPES)).withWatermark("event_ts", delay)
    # the window itself is the key: Spark ends state by it, which a bare start would not allow
    g = s.groupBy(F.window("event_ts", window).alias("w"), *EQUIPMENT_KEYS, "event_date").agg(*equipment_aggs())
    return g.select(*EQUIPMENT_KEYS, F.col("w.start").alias("window_5min"), *[c for c in g.columns if c not in ("w", *EQUIPMENT_KEYS)])


def upsert_table(spark: SparkSession, path: str, schema: T.StructType, keys) -> DeltaTable:
    """A table of the newest row per key: rows of a later micro-batch replace those of earlier ones."""
    values = [f.name for f in schema.fields if f.name not in keys]

    def newest(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"), F.max("epoch").alias("epoch"))
        return last.select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values], "epoch")

    stored = T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])
    return DeltaTable(spark, path, T.StructType([stored[c] for c in (*keys, *values, "epoch")]), newest)


def upsert_foreach_batch(path: str, schema: T.StructType, keys):
    """The ``foreachBatch`` function for a stream in update mode."""
    def run(batch_df: DataFrame, epoch: int) -> None:
        upsert_table(batch_df.sparkSession, path, schema, keys).append(batch_df.withColumn("epoch", F.lit(epoch).cast("long")), epoch)
    return run


# -- A11 ------------------------------------------------------------------------------------------
def event_rate_stream(events: DataFrame, delay: str = "10 minutes", tick: str = "5 seconds", tick_seconds: int = C.RATE_TICK_SECONDS,
                      keys=DEDUP_KEYS) -> DataFrame:
    """A11 on a stream: repeats go within the watermark, then ticks are counted and appended once they are
    ``delay`` old.  A tick is final when later events have come: the feed's own next ones, or a heartbeat."""
    once = events.select(*keys).withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(list(keys))
    return (once.groupBy(F.window("event_ts", tick).alias("w")).agg(F.count(F.lit(1)).alias("new_events"))
            .select(F.col("w.start").alias("tick_start"), "new_events",
                    F.round(F.col("new_events") / float(tick_seconds)).cast("long").alias("events_per_sec")))


# -- the feed's buffer ----------------------------------------------------------------------------
def newest_once(silver_rows: DataFrame, rows: int = C.BUFFER_ROWS) -> DataFrame:
    """The newest ``rows`` events, repeats of (time, machine, type) once.  The order is total over those keys, so
    the newest of several slices' newest are the newest of all."""
    rest = [c for c in silver_rows.columns if c not in DEDUP_KEYS]
    newest_first = [F.col(k).desc_nulls_last() for k in DEDUP_KEYS]
    once = silver_rows.groupBy(*DEDUP_KEYS).agg(F.min_by(F.struct(*rest), "event_id").alias("_row"))
    return once.orderBy(*newest_first).limit(rows).select(*DEDUP_KEYS, *[F.col(f"_row.{c}").alias(c) for c in rest])


_BUFFER_COLUMNS = ("event_ts", "equipment_id", "event_type", "event_id", "equipment_name", "equipment_type", "plant_id", "line_id", "batch_id",
                   "temperature_c", "moisture_pct", "energy_kwh", "flow_rate_l_min", "viscosity_cp", "pressure_kpa", "alarm_code", "moisture_quality")


def feed_buffer(spark: SparkSession, path: str, silver: T.StructType, rows: int = C.BUFFER_ROWS) -> DeltaTable:
    """The live feed's buffer: every micro-batch adds its own newest ``rows`` events, and a reader merges a few
    such lists."""
    return DeltaTable(spark, path, T.StructType([silver[c] for c in _BUFFER_COLUMNS]), lambda df: newest_once(df, rows))


def buffer_foreach_batch(path: str, silver: T.StructType, rows: int = C.BUFFER_ROWS):
    return append_to(lambda spark: (feed_buffer(spark, path, silver, rows), lambda df: newest_once(df.select(*_BUFFER_COLUMNS), rows)))


def buffer_events(buffer: DeltaTable) -> DataFrame:
    """The buffer as the feed's live events."""
    return live_projection(buffer.read()).select(*LIVE_COLUMNS)


# -- alerts -----------------------------------------------------------------------------------------
def first_alarm_table(spark: SparkSession, path: str, silver: T.StructType) -> DeltaTable:
    """The earliest alarm per machine, whatever the order in which alarms arrive."""
    schema = P.first_alarms(spark.createDataFrame([], silver)).schema
    return DeltaTable(spark, path, schema, P.merge_first_alarms)


def alarms_foreach_batch(path: str, silver: T.StructType):
    return append_to(lambda spark: (first_alarm_table(spark, path, silver), P.first_alarms))


def alert_board(first_alarms: DataFrame, gold_eq: DataFrame, window: str = C.EQUIPMENT_WINDOW) -> DataFrame:
    """X7 + K2: one alert per machine that ever raised an alarm, with the severity of the gold window in which it
    first did."""
    f = first_alarms.select(F.col("equipment_id").alias("_id"), bucket_start("event_ts", window).alias("_w"), F.col("event_ts").alias("first_alarm_ts"),
                            "alarm_code", "alarm_severity")
    g = gold_eq.filter(F.col("alarm_count") > 0)
    names = ("equipment_name", "equipment_type", "line_id", "plant_id")
    j = g.join(f, F.col("equipment_id").eqNullSafe(F.col("_id")) & (F.col("window_5min") == F.col("_w")))
    one = j.groupBy("equipment_id").agg(F.min_by(F.struct("window_5min", *names, "alarm_count", "avg_temperature_c", "first_alarm_ts", "alarm_code",
                                                          "alarm_severity"), F.struct(*names)).alias("_a"))
    return alert_columns(one.select("equipment_id", "_a.*"))


# -- layout -----------------------------------------------------------------------------------------
CLUSTER = ("plant_id", "equipment_type", "equipment_id", "event_ts")


def clustered_table(spark: SparkSession, path: str, schema: T.StructType, row_group_bytes: int | None = None) -> DeltaTable:
    """Events dealt by range and sorted by plant, type, machine and time, in row groups with a Bloom filter on
    the machine: a reader of one plant, type or machine skips all others.  Blocks of micro-batches are compacted
    by powers, so files grow with the table instead of their number."""
    options = {"parquet.bloom.filter.enabled#equipment_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    return DeltaTable(spark, path, schema, lambda df: df, CLUSTER, cluster_deltas=True, options=options)


def clustered_foreach_batch(path: str, schema: T.StructType, row_group_bytes: int | None = None):
    return append_to(lambda spark: (clustered_table(spark, path, schema, row_group_bytes), lambda df: df))
