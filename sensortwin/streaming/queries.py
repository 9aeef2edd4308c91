"""Registered streaming queries: the pipeline is driven over the whole events table.

The table is written to a landing folder in instalments and drained with
``availableNow`` after each one (queries restart from their checkpoints between
instalments).  The instalments are hash-spread, so every gold partition is touched
several times and rows arrive late -- the result must still equal the batch plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import register, to_ntz
from ..plans.inputs import Inputs
from ..plans.present import present
from ..sources.events import replay_to_landing
from ..operators.gold import batch_yield, equipment_metrics, sustainability_hourly
from ..operators.layers import to_silver
from ..operators.partials import distinct_estimates
from . import views
from .pipeline import (BRONZE_SCHEMA, GOLD_TABLES, TwinPaths, bronze_stream, dedup_foreach_batch, delta_table, live_tail, new_paths, read_alerts,
                       read_gold, read_or_empty, read_silver, rebuild_all, run_available, silver_schema, silver_stream, start_alarms)

INSTALMENTS = 3


def _canonical(df: DataFrame, like: DataFrame) -> DataFrame:
    """Column order of the batch operator's output (stored tables put partition columns last)."""
    return df.select(*[c for c in like.columns if c in df.columns])


def _empty_silver(spark: SparkSession) -> DataFrame:
    return to_silver(spark.createDataFrame([], BRONZE_SCHEMA))


def _instalments(raw: DataFrame, n: int = INSTALMENTS) -> list[DataFrame]:
    """Hash-spread slices of the whole table (their union is every row)."""
    h = F.pmod(F.xxhash64("event_id"), F.lit(n))
    return [raw.filter(h == i) for i in range(n)]


def _drain(writer, paths: TwinPaths, name: str, out: str | None = None) -> None:
    """Run a stream over all that has landed, from its checkpoint."""
    w = writer.option("checkpointLocation", paths.ckpt(name)).trigger(availableNow=True)
    q = w.start(out) if out else w.start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _numbered(raw: DataFrame, n: int = INSTALMENTS) -> list[DataFrame]:
    """Instalments by event number (their union is every row); one without a number goes first."""
    number = F.coalesce(F.pmod(F.col("event_id").try_cast("long"), F.lit(n)), F.lit(0))
    return [raw.filter(number == i) for i in range(n)]


def _in_time_order(t: Inputs, n: int = INSTALMENTS) -> list[DataFrame]:
    """Slices of the whole table by event time, oldest first; events without a time come first."""
    secs = F.col("event_ts").cast("timestamp").cast("long")
    bounds = t.raw.select(F.percentile_approx(secs, [i / n for i in range(1, n)], 10000)).first()[0]  # n - 1 numbers
    if bounds is None:
        return [t.replayed]
    slot = sum((F.coalesce(secs > b, F.lit(False)).cast("int") for b in bounds), F.lit(0))
    return [t.replayed.filter(slot == i) for i in range(n)]


def run_pipeline(spark: SparkSession, sf_dir: str, gold: bool = True, tables=GOLD_TABLES, quarantine: bool = False,
                 live: tuple = ()) -> TwinPaths:
    """Replay the whole table in instalments; after each, drain bronze (+ quarantine) + silver, then the
    deltas of the gold ``tables`` and the ``live`` views."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "twin")
    for part in _instalments(t.replayed):
        replay_to_landing(part, paths.landing)
        run_available(spark, paths, quarantine=quarantine, gold=gold, tables=tables, live=live)
    return paths


@register("stream_silver_events")
def stream_silver_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2 + S3 + S8 + S9: silver (and the quarantine beside it) produced by the chained
    streams."""
    silver = read_silver(spark, run_pipeline(spark, sf_dir, gold=False, quarantine=True))
    return present(to_ntz(_canonical(silver, _empty_silver(spark))), exact=True)


@register("stream_equipment_metrics")
def stream_equipment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + X3 + X5: A1 kept by mergeable deltas of the micro-batches."""
    paths = run_pipeline(spark, sf_dir, tables=("equipment_metrics",))
    like = equipment_metrics(_empty_silver(spark))
    return present(to_ntz(_canonical(read_gold(spark, paths, "equipment_metrics"), like)))


@register("stream_batch_yield")
def stream_batch_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + X5: A2 kept by mergeable deltas."""
    paths = run_pipeline(spark, sf_dir, tables=("batch_yield",))
    like = batch_yield(_empty_silver(spark))
    return present(to_ntz(_canonical(read_gold(spark, paths, "batch_yield"), like)))


@register("stream_sustainability_hourly")
def stream_sustainability_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10 + X4 + X5: A3 kept by mergeable deltas."""
    paths = run_pipeline(spark, sf_dir, tables=("sustainability_hourly",))
    like = sustainability_hourly(_empty_silver(spark))
    return present(to_ntz(_canonical(read_gold(spark, paths, "sustainability_hourly"), like)))


@register("stream_alerts")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7 + K2: an alert per machine that ever raised an alarm, with its first alarm and the severity of
    the gold window it fell in; alarms arrive in any order."""
    paths = run_pipeline(spark, sf_dir, tables=("equipment_metrics",), live=(start_alarms,))
    return present(to_ntz(read_alerts(spark, paths)))


@register("stream_full_refresh")
def stream_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly table after a full refresh over the landing files of a pipeline that ran before, a
    few files at a time."""
    fresh = rebuild_all(spark, run_pipeline(spark, sf_dir, gold=False), max_files=200)
    like = sustainability_hourly(_empty_silver(spark))
    return present(to_ntz(_canonical(read_gold(spark, fresh, "sustainability_hourly"), like)))


@register("stream_distinct_counts")
def stream_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3.1 by day: machines and batches of each plant from merged deltas, exactly from the member rows and as the
    estimate of merged sketches, which is checked against its stated error."""
    paths = run_pipeline(spark, sf_dir, tables=("sustainability_hourly",))
    keys = ("plant_id", "event_date")
    members = delta_table(spark, paths, "members").read().select(*keys, "kind", "member").distinct()
    exact = members.groupBy(*keys).agg(*[F.count(F.when(F.col("kind") == kind, 1)).alias(name)
                                         for kind, name in (("equipment", "machines"), ("batch", "batches"))])
    estimate = distinct_estimates(delta_table(spark, paths, "sustainability").read(), *keys)

    def close(guess: str, count: str):  # three standard errors, and one for rounding
        return F.abs(F.col(guess) - F.col(count)) <= 3 * views.P.SKETCH_ERROR * F.col(count) + 1

    return present(exact.join(estimate, list(keys)).select(*keys, "machines", "batches", close("equipment_estimate", "machines").alias("machines_close"),
                                                           close("batch_estimate", "batches").alias("batches_close")))


@register("stream_equipment_metrics_watermarked")
def stream_equipment_metrics_watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X5 with a watermark: A1 in update mode, upserted by key.  The table lands in time order, so no event is
    later than the watermark and every window is whole."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "watermark")
    schema = views.equipment_metrics_stream(_empty_silver(spark)).schema
    keys, out = [*views.EQUIPMENT_KEYS, "window_5min", "event_date"], paths.path("upserts")
    for part in _in_time_order(t):
        replay_to_landing(part, paths.landing)
        stream = views.equipment_metrics_stream(to_silver(bronze_stream(spark, paths.landing)))
        _drain(stream.writeStream.outputMode("update").foreachBatch(views.upsert_foreach_batch(out, schema, keys)), paths, "watermark")
    table = views.upsert_table(spark, out, schema, keys).read()
    return present(to_ntz(_canonical(table, equipment_metrics(_empty_silver(spark), computed_at=False))))


@register("stream_event_rate")
def stream_event_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11 on the stream: repeats go, ticks are counted.  Every slice lands twice, and a heartbeat after the last event
    closes the last ticks."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "rate")
    out = paths.path("ticks")
    last = t.raw.select(F.max(F.col("event_ts").cast("timestamp"))).first()[0]  # one value
    parts = [p for part in _in_time_order(t) for p in (part, part)]
    if last is not None:
        beat = F.lit(last) + F.expr("INTERVAL 1 HOUR")
        one = t.raw.select(*[F.lit("heartbeat").alias(c) if c in ("event_id", "event_type", "equipment_id") else beat.cast(t.raw.schema[c].dataType).alias(c)
                             if c == "event_ts" else F.lit(None).cast(t.raw.schema[c].dataType).alias(c) for c in t.raw.columns]).limit(1)
        parts.append(one)
    for part in parts:
        replay_to_landing(part, paths.landing)
        stream = views.event_rate_stream(to_silver(bronze_stream(spark, paths.landing)))
        _drain(stream.writeStream.format("parquet").outputMode("append"), paths, "rate", out)
    schema = views.event_rate_stream(_empty_silver(spark)).schema
    return present(to_ntz(read_or_empty(spark, out, schema)))


@register("stream_feed_buffer")
def stream_feed_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 + T8: the feed's 300 newest events after each of three instalments."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "buffer")
    silver, taken = _empty_silver(spark).schema, []
    for i, part in enumerate(_numbered(t.replayed)):
        replay_to_landing(part, paths.landing)
        stream = to_silver(bronze_stream(spark, paths.landing))
        _drain(stream.writeStream.foreachBatch(views.buffer_foreach_batch(paths.path("buffer"), silver)), paths, "buffer")
        buffer = views.feed_buffer(spark, paths.path("buffer"), silver)  # the blocks it reads stay as they are
        taken.append(views.buffer_events(buffer).withColumn("instalment", F.lit(i + 1)))
    return present(taken[0].unionByName(taken[1]).unionByName(taken[2]))


@register("silver_clustered_lookup")
def silver_clustered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9 + P11: one machine's events from silver laid out by plant, type and machine with Bloom filters; the machine
    is the one of the smallest id."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "clustered")
    schema, out = _empty_silver(spark).schema, paths.path("silver_clustered")
    for part in _instalments(t.replayed):
        replay_to_landing(part, paths.landing)
        stream = to_silver(bronze_stream(spark, paths.landing))
        _drain(stream.writeStream.foreachBatch(views.clustered_foreach_batch(out, schema)), paths, "clustered")
    one = t.registry.agg(F.min("equipment_id")).scalar()
    rows = views.clustered_table(spark, out, schema).read().filter(F.col("equipment_id") == one)
    return present(to_ntz(rows.select("event_id", "event_ts", "event_type", "equipment_id", "plant_id", "temperature_c", "alarm_code")))


@register("stream_live_tail")
def stream_live_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6 + P17: the live-event projection as an append stream over silver, drained after
    every instalment (a streamed tail carries no order)."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "tail")
    out = paths.path("live_tail")
    for part in _instalments(t.replayed):
        replay_to_landing(part, paths.landing)
        run_available(spark, paths, quarantine=False, gold=False)
        _drain(live_tail(silver_stream(spark, paths.bronze)).writeStream.format("parquet").outputMode("append"), paths, "live_tail", out)
    schema = live_tail(spark.createDataFrame([], silver_schema(spark))).schema
    return present(read_or_empty(spark, out, schema))


@register("stream_dedup")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lossless dedup of the silver stream over the whole table.  The instalments come newest
    first, so most events arrive days late, and the middle one lands twice; no distinct event is
    lost and no repeated one kept."""
    t = Inputs(spark, sf_dir)
    paths = new_paths(spark, "dedup")
    out = paths.path("dedup")
    secs = F.col("event_ts").cast("timestamp").cast("long")
    bounds = t.raw.select(F.percentile_approx(secs, [1 / 3, 2 / 3], 10000)).first()[0]  # two scalars
    if bounds is None:  # no event has a time
        parts = [t.replayed]
    else:
        b1, b2 = bounds
        middle = t.replayed.filter((secs >= b1) & (secs < b2))
        parts = [t.replayed.filter(secs >= b2), middle, middle, t.replayed.filter((secs < b1) | secs.isNull())]
    for part in parts:
        replay_to_landing(part, paths.landing)
        s = to_silver(bronze_stream(spark, paths.landing))
        _drain(s.writeStream.foreachBatch(dedup_foreach_batch(out)), paths, "dedup")
    like = _empty_silver(spark)
    return present(to_ntz(_canonical(read_or_empty(spark, out, silver_schema(spark)), like)), exact=True)
