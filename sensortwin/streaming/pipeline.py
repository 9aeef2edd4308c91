"""Structured Streaming: landing JSON -> bronze -> silver -> incremental gold.

* bronze / quarantine / silver are append-only file sinks with their own checkpoints
  (exactly-once through the sink's commit log);
* gold is kept exact and late-safe without streaming state: a silver micro-batch adds the
  partial states of its own rows to a table of deltas (``deltas.py``), which are merged when
  gold is read and compacted by powers of their number.  A micro-batch reads neither silver
  nor gold, late rows merge like all others, and one that runs again after a loss writes the
  same deltas again.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from ..operators import partials as P
from ..operators.gold import batch_partials, batch_yield_from_partials
from ..operators.layers import to_bronze, to_silver
from ..session import scratch_path
from ..schemas import EVENT_SCHEMA
from ..sources.events import read_events_stream, split_corrupt, with_ingest_metadata
from . import views
from .deltas import DeltaTable

BRONZE_SCHEMA = T.StructType(
    [T.StructField(f.name, T.TimestampType() if f.name == "event_ts" else f.dataType) for f in EVENT_SCHEMA.fields]
    + [T.StructField("_ingested_at", T.TimestampType()), T.StructField("_source_file", T.StringType()),
       T.StructField("_file_modified_at", T.TimestampType())])


@lru_cache(maxsize=8)
def silver_schema(spark: SparkSession) -> T.StructType:
    """Schema of the stored silver table: the silver columns with the ``event_date``
    partition column last.  Spark appends partition columns after the data columns; a
    stream that starts before any partition directory exists would otherwise read every
    column after ``batch_id`` shifted by one once the partitions appear."""
    s = to_silver(spark.createDataFrame([], BRONZE_SCHEMA)).schema
    return T.StructType([f for f in s.fields if f.name != "event_date"] + [s["event_date"]])


@dataclass(frozen=True)
class TwinPaths:
    """Every table and checkpoint of one pipeline, below one shared root."""
    root: str
    landing_dir: str | None = None  # where event files arrive; default ROOT/landing

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def landing(self): return self.landing_dir or self.path("landing")
    @property
    def bronze(self): return self.path("bronze")
    @property
    def quarantine(self): return self.path("quarantine")
    @property
    def silver(self): return self.path("silver")
    def ckpt(self, name: str) -> str:
        return self.path(f"_checkpoints/{name}")


def new_paths(spark: SparkSession, name: str = "twin") -> TwinPaths:
    """X9 helper: a fresh root (new checkpoints, empty tables) below ``spark.checkpoint.dir``."""
    return TwinPaths(scratch_path(spark, name))


def _trigger(writer, trigger):
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer.trigger(processingTime=trigger)


# ---------------------------------------------------------------------------
# streams
# ---------------------------------------------------------------------------


def bronze_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """Typed permissive JSON stream + ingest metadata -> bronze rows.

    Like the application's bronze table, every landed line is kept (a broken line is an
    all-NULL row); silver's null guard drops what is unusable, and the quarantine stream
    lists those rows with their raw text.
    """
    return to_bronze(with_ingest_metadata(read_events_stream(spark, landing, max_files)))


def quarantine_stream(spark: SparkSession, landing: str, max_files: int | None = None) -> DataFrame:
    """S3: the rows silver will drop (no id / unusable timestamp), with the raw line when
    Spark kept it."""
    raw = with_ingest_metadata(read_events_stream(spark, landing, max_files))
    _good, bad = split_corrupt(raw)
    return bad


def start_bronze(spark: SparkSession, paths: TwinPaths, trigger=None, max_files: int | None = None) -> StreamingQuery:
    """Append bronze parquet, exactly once via the checkpoint."""
    w = (bronze_stream(spark, paths.landing, max_files).writeStream.format("parquet")
         .option("checkpointLocation", paths.ckpt("bronze")).outputMode("append"))
    return _trigger(w, trigger).start(paths.bronze)


def start_quarantine(spark: SparkSession, paths: TwinPaths, trigger=None) -> StreamingQuery:
    """S3: append the rows silver will drop, with their raw text, for inspection."""
    w = (quarantine_stream(spark, paths.landing).writeStream.format("parquet")
         .option("checkpointLocation", paths.ckpt("quarantine")).outputMode("append"))
    return _trigger(w, trigger).start(paths.quarantine)


def _file_stream(spark: SparkSession, schema: T.StructType, max_files: int | None = None):
    r = spark.readStream.schema(schema)
    return r.option("maxFilesPerTrigger", int(max_files)) if max_files else r


def silver_stream(spark: SparkSession, bronze_path: str, max_files: int | None = None) -> DataFrame:
    """Bronze read as a stream -> silver rows (``max_files`` bronze files per micro-batch)."""
    return to_silver(_file_stream(spark, BRONZE_SCHEMA, max_files).parquet(bronze_path))


def start_silver(spark: SparkSession, paths: TwinPaths, trigger=None, max_files: int | None = None) -> StreamingQuery:
    """Append silver parquet, partitioned by ``event_date`` for pruning."""
    w = (silver_stream(spark, paths.bronze, max_files).writeStream.format("parquet")
         .option("checkpointLocation", paths.ckpt("silver")).outputMode("append").partitionBy("event_date"))
    return _trigger(w, trigger).start(paths.silver)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The parquet table at ``path`` read with its known schema; an empty frame of that
    schema when nothing has been written there yet (no data has arrived)."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_silver(spark: SparkSession, paths: TwinPaths) -> DataFrame:
    return read_or_empty(spark, paths.silver, silver_schema(spark))


# ---------------------------------------------------------------------------
# incremental gold
# ---------------------------------------------------------------------------


def _overwrite(df: DataFrame, path: str, *partition: str) -> None:
    """Dynamic partition overwrite.  Rows of a partition value are brought together, but by a
    rebalance: adaptive execution splits large values over several writers."""
    (df.hint("rebalance", *[F.col(p) for p in partition]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition).parquet(path))


GOLD_TABLES = ("equipment_metrics", "sustainability_hourly", "batch_yield")

# what a slice of silver adds to the delta tables behind each gold table, how deltas merge, and what they are clustered by
_DELTAS = {
    "equipment_metrics": {"equipment": (P.equipment_partials, P.merge_equipment_partials, ("event_date", "window_5min"))},
    "sustainability_hourly": {"sustainability": (P.sustainability_partials, P.merge_sustainability_partials, ("event_date", "hour_bucket")),
                              "members": (P.sustainability_members, P.merge_members, ("event_date", "hour_bucket"))},
    "batch_yield": {"batch": (batch_partials, P.merge_batch_partials, ("batch_id",))},
}


@lru_cache(maxsize=8)
def _delta_schemas(spark: SparkSession) -> dict[str, T.StructType]:
    empty = spark.createDataFrame([], silver_schema(spark))
    return {name: partial(empty).schema for tables in _DELTAS.values() for name, (partial, _, _) in tables.items()}


def delta_table(spark: SparkSession, paths: TwinPaths, name: str) -> DeltaTable:
    """One of the delta tables behind gold: equipment, sustainability, members or batch."""
    merge, cluster = next(tables[name][1:] for tables in _DELTAS.values() if name in tables)
    return DeltaTable(spark, paths.path(f"gold_deltas/{name}"), _delta_schemas(spark)[name], merge, cluster)


def gold_foreach_batch(paths: TwinPaths, computed_at=None, tables=GOLD_TABLES):
    """S10 + X5: the ``foreachBatch`` function.  No watermark: late rows are always counted."""
    def run(batch_df: DataFrame, epoch_id: int) -> None:
        spark = batch_df.sparkSession

        def append(name, partial):
            stamped = {"computed_at": computed_at} if partial in (P.equipment_partials, P.sustainability_partials) else {}
            delta_table(spark, paths, name).append(partial(batch_df, **stamped), epoch_id)

        _together(spark, [lambda n=name, p=partial: append(n, p) for t in tables for name, (partial, _, _) in _DELTAS[t].items()])
    return run


def _together(spark: SparkSession, jobs) -> None:
    """Independent jobs over the same slice, submitted concurrently (each scans just its columns) with the
    caller's job group and description, so that stopping the stream cancels them too."""
    sc = spark.sparkContext
    props = {k: sc.getLocalProperty(k) for k in _INHERITED_PROPERTIES}

    def run(job):
        for k, v in props.items():
            if v is not None:
                sc.setLocalProperty(k, v)
        job()

    with ThreadPoolExecutor(max_workers=4) as pool:
        for f in [pool.submit(run, job) for job in jobs]:
            f.result()


_INHERITED_PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel",
                         "spark.scheduler.pool", "sql.streaming.queryId", "streaming.sql.batchId")


def start_gold(spark: SparkSession, paths: TwinPaths, trigger=None, computed_at=None,
               tables=GOLD_TABLES, max_files: int | None = None) -> StreamingQuery:
    src = _file_stream(spark, silver_schema(spark), max_files).parquet(paths.silver)
    w = (src.writeStream.foreachBatch(gold_foreach_batch(paths, computed_at, tables))
         .option("checkpointLocation", paths.ckpt("gold")))
    return _trigger(w, trigger).start()


# ---------------------------------------------------------------------------
# live views beside gold (X6, X7, S9): streams over the stored silver table
# ---------------------------------------------------------------------------


def _silver_to(spark: SparkSession, paths: TwinPaths, name: str, each, trigger, max_files: int | None = None) -> StreamingQuery:
    src = _file_stream(spark, silver_schema(spark), max_files).parquet(paths.silver)
    return _trigger(src.writeStream.foreachBatch(each).option("checkpointLocation", paths.ckpt(name)), trigger).start()


def start_alarms(spark: SparkSession, paths: TwinPaths, trigger=None) -> StreamingQuery:
    """Keep the first alarm of each machine."""
    return _silver_to(spark, paths, "alarms", views.alarms_foreach_batch(paths.path("alarms"), silver_schema(spark)), trigger)


def start_buffer(spark: SparkSession, paths: TwinPaths, trigger=None) -> StreamingQuery:
    """X6 + T8: keep the live feed's newest events."""
    return _silver_to(spark, paths, "buffer", views.buffer_foreach_batch(paths.path("buffer"), silver_schema(spark)), trigger)


def start_clustered(spark: SparkSession, paths: TwinPaths, trigger=None, row_group_bytes: int | None = None) -> StreamingQuery:
    """Keep a copy of silver laid out by plant, type and machine, for lookups."""
    each = views.clustered_foreach_batch(paths.path("silver_clustered"), silver_schema(spark), row_group_bytes)
    return _silver_to(spark, paths, "silver_clustered", each, trigger)


def read_alerts(spark: SparkSession, paths: TwinPaths) -> DataFrame:
    """X7 + K2: the alert board."""
    first = views.first_alarm_table(spark, paths.path("alarms"), silver_schema(spark)).read()
    return views.alert_board(first, read_gold(spark, paths, "equipment_metrics"))


def read_buffer(spark: SparkSession, paths: TwinPaths) -> DataFrame:
    """X6 + T8: the live feed's newest events."""
    return views.buffer_events(views.feed_buffer(spark, paths.path("buffer"), silver_schema(spark)))


def read_clustered(spark: SparkSession, paths: TwinPaths) -> DataFrame:
    """Silver by plant, type and machine."""
    return views.clustered_table(spark, paths.path("silver_clustered"), silver_schema(spark)).read()


def read_gold(spark: SparkSession, paths: TwinPaths, table: str | None = None):
    """The gold tables, merged from their deltas (all as a dict, or one by name); empty until data
    arrives.  Filters on windows, hours and dates reach the scan of the deltas."""
    def held(name: str) -> DataFrame:
        return delta_table(spark, paths, name).read()

    frames = {
        "equipment_metrics": lambda: P.equipment_from_partials(held("equipment"), computed_at=True),
        "sustainability_hourly": lambda: P.sustainability_from_partials(held("sustainability"), held("members"), computed_at=True),
        "batch_yield": lambda: batch_yield_from_partials(held("batch")),
    }
    if table is not None:
        return frames[table]()
    return {name: frame() for name, frame in frames.items()}


def run_available(spark: SparkSession, paths: TwinPaths, quarantine: bool = True, gold: bool = True,
                  tables=GOLD_TABLES, live: tuple = ()) -> None:
    """Drain everything that has landed: bronze, (quarantine), silver, (gold and the ``live`` views, such as
    ``start_alarms``), in order.

    Each stage runs with ``availableNow`` and restarts from its checkpoint, so calling
    this after every landing instalment behaves like a continuously running pipeline.
    """
    # bronze and quarantine read the landing folder independently: run them side by side
    first = [start_bronze(spark, paths)] + ([start_quarantine(spark, paths)] if quarantine else [])
    for q in first:
        _await(q)
    _await(start_silver(spark, paths))
    # gold and the views read silver independently
    last = [start_gold(spark, paths, tables=tables)] if gold else []
    for q in last + [start(spark, paths) for start in live]:
        _await(q)


def _await(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def rebuild_all(spark: SparkSession, old: TwinPaths, name: str = "twin",
                max_files: int | None = None) -> TwinPaths:
    """Full refresh -- new checkpoints and empty tables over the same landing files.

    Old paths are left in place (nothing is deleted); the returned paths replace them.
    ``max_files`` bounds every micro-batch of the replay (files per trigger), so a long
    history is rebuilt in restartable steps rather than one giant batch per stage.
    """
    fresh = new_paths(spark, name)
    bronze = (bronze_stream(spark, old.landing, max_files).writeStream.format("parquet")
              .option("checkpointLocation", fresh.ckpt("bronze")).outputMode("append")
              .trigger(availableNow=True).start(fresh.bronze))
    _await(bronze)
    _await(start_silver(spark, fresh, max_files=max_files))
    _await(start_gold(spark, fresh, max_files=max_files))
    return fresh


# ---------------------------------------------------------------------------
# streaming-only operators
# ---------------------------------------------------------------------------


DEDUP_KEYS = ("event_ts", "equipment_id", "event_type")


def dedup_foreach_batch(out: str, keys=DEDUP_KEYS):
    """X8/D3 without loss: the ``foreachBatch`` function that appends to the table at ``out`` the
    first event of each key, however late it arrives.

    A micro-batch drops its own repeats (the smallest event id stays), then the keys that the
    table already holds; only the table's partitions of the dates the batch touches are read.
    Rows go to a partition of the batch's own number, which a re-run of the batch ignores and
    replaces, so a retry neither loses nor repeats an event.  Events without a time or date stay
    in the null partition.
    """
    from ..operators.serving import dedup_events

    def run(batch_df: DataFrame, epoch: int) -> None:
        spark = batch_df.sparkSession
        dates = [r[0] for r in batch_df.select("event_date").distinct().collect()]  # days of one micro-batch
        new = dedup_events(batch_df, keys)
        schema = T.StructType([f for f in batch_df.schema.fields if f.name != "event_date"]
                              + [batch_df.schema["event_date"], T.StructField("epoch", T.LongType())])
        touched = F.col("event_date").isin([d for d in dates if d is not None])
        touched = touched | F.col("event_date").isNull() if None in dates else touched
        held = read_or_empty(spark, out, schema).where(touched & (F.col("epoch") < epoch)).select(
            *[F.col(k).alias(f"_{k}") for k in keys])
        new = new.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti").withColumn("epoch", F.lit(epoch).cast("long"))
        _overwrite(new.select(*schema.names), out, "event_date", "epoch")

    return run


def dedup_stream(events: DataFrame, delay: str = "10 minutes",
                 keys=DEDUP_KEYS, salt_buckets: int = 1) -> DataFrame:
    """D3 with bounded state, for a live view only: repeats of (event_ts, machine, type) seen
    within ``delay`` are dropped, and so is **any event later than ``delay``**, repeated or not
    (the watermark discards it).  Where no event may be lost use :func:`dedup_foreach_batch`.

    ``salt_buckets > 1`` splits hot groups of copies: a first dedup on the key plus the
    input partition id (mod the bucket count) spreads the copies of one key over up to
    that many tasks and leaves at most one copy per bucket; the second dedup on the key
    alone then sees at most ``salt_buckets`` copies per key.
    """
    w = events.withWatermark("event_ts", delay)
    if salt_buckets > 1:
        salted = w.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt_buckets)))
        w = salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return w.dropDuplicatesWithinWatermark(list(keys))


def live_tail(silver: DataFrame) -> DataFrame:
    """The live-event projection as an append stream (a streamed tail has no order)."""
    from ..operators.serving import live_projection
    return live_projection(silver)
