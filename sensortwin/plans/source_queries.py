"""Registered queries of sources, sinks and named tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import serving, sql_lookups, whatif
from ..schemas import EQUIPMENT_SCHEMA, EVENT_COLUMNS, RAW_MATERIAL_BATCH_SCHEMA
from ..session import scratch_path
from ..sources.catalog import TwinCatalog
from ..sources.events import quarantine_reason, read_events_batch, replay_to_landing, to_landing_json, with_ingest_metadata
from ..sources.reference import batches_reference, load_reference, peek, read_batches_csv
from ..streaming.pipeline import new_paths, read_or_empty, start_quarantine
from .catalog import _requests, register, to_ntz
from .inputs import Inputs
from .present import present


def _new_catalog(spark: SparkSession) -> TwinCatalog:
    """A namespace of its own below the shared folder."""
    return TwinCatalog(spark, f"twin_{uuid.uuid4().hex[:12]}", scratch_path(spark, "catalog")).create()


# --- landing files ------------------------------------------------------------------------------
@register("stream_quarantine")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: lines that broke off, name no event or hold no usable time, as the quarantine stream lists them.  Of
    the events 3 in 7 land damaged in one of those ways, the others whole."""
    good = to_landing_json(Inputs(spark, sf_dir).raw)
    way = F.pmod(F.col("event_id").cast("long"), F.lit(7))
    whole = F.to_json(F.struct(*EVENT_COLUMNS))
    line = (F.when(way == 1, F.format_string('{"event_id":"%s","event_ts"', F.col("event_id")))
            .when(way == 2, F.format_string('{"event_id":"%s","event_ts":"not a time"}', F.col("event_id")))
            .when(way == 3, F.format_string('{"event_type":"%s","event_ts":"2024-01-01T00:00:00+00:00"}', F.col("event_id"))).otherwise(whole))
    paths = new_paths(spark, "quarantine")
    good.select(line.alias("value")).write.text(paths.landing)
    q = start_quarantine(spark, paths)
    q.awaitTermination()
    schema = read_events_batch(spark, paths.landing).schema
    bad = read_or_empty(spark, paths.quarantine, schema)
    return present(bad.select("event_id", "event_type", "event_ts", F.col("_corrupt_record").alias("line"), quarantine_reason().alias("reason")))


@register("ingest_metadata")
def ingest_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type that carry a landing file of theirs, its time, and a later time of ingest."""
    landing = scratch_path(spark, "landing")
    replay_to_landing(Inputs(spark, sf_dir).replayed, landing)
    e = with_ingest_metadata(read_events_batch(spark, landing))
    folder = landing.rstrip("/").rsplit("/", 1)[1]
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("_source_file").rlike(rf"/{folder}/[^/]+\.json$")).alias("with_file"),
        F.count("_file_modified_at").alias("with_file_time"), F.count_if(F.col("_ingested_at") >= F.col("_file_modified_at")).alias("ingested_later"))


# --- dimensions ---------------------------------------------------------------------------------
def _as_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", "true").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ssXXX").csv(path)
    return path


@register("reference_load")
def reference_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S7 + S11: the registry as a CSV file with a header, loaded into a table of a new namespace (twice: the second
    load replaces the first), read by name."""
    registry = Inputs(spark, sf_dir).registry
    catalog = _new_catalog(spark)
    load_reference(spark, _as_csv(registry.limit(1), "one-csv"), EQUIPMENT_SCHEMA, catalog.name("equipment"))
    load_reference(spark, _as_csv(registry, "equipment-csv"), EQUIPMENT_SCHEMA, catalog.name("equipment"))
    return present(catalog.table("equipment"))


def _raw_material(t: Inputs) -> DataFrame:
    """Raw-material batches in the reference file's form, one per customer row."""
    c, k = t.table("customer"), F.col("c_custkey")
    made = {
        "batch_id": F.format_string("RM-%06d", k), "plant_id": F.when(k % 3 == 2, "PLANT-2").otherwise("PLANT-1"), "milk_origin": F.col("c_mktsegment"),
        "product_type": F.when(k % 2 == 0, "infant, \"stage 1\"").otherwise("whole – Ö"), "protein_pct": 30 + (k % 40) / 8.0, "fat_pct": 24 + (k % 32) / 8.0,
        "lactose_pct": F.when(k % 5 != 0, 35 + (k % 16) / 4.0), "moisture_pct": 3 + (k % 8) / 4.0, "viscosity_cp": (k % 500 + 600).cast("int"),
        "volume_liters": F.when(k % 9 != 0, (k % 100 * 500).cast("int")),
        "received_at": F.timestamp_seconds(F.lit(1_704_067_200) + k.cast("long") * 60), "supplier_id": F.format_string("SUP-%d", F.col("c_nationkey")),
        "quality_grade": F.when(k % 4 == 0, "A+").otherwise("A"),
    }
    return c.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in RAW_MATERIAL_BATCH_SCHEMA.fields])


@register("raw_material_batches")
def raw_material_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 + S14: raw-material batches read from CSV (quotes, commas, UTF-8, empty fields), listed by id."""
    csv = _as_csv(_raw_material(Inputs(spark, sf_dir)), "batches-csv")
    return present(to_ntz(batches_reference(read_batches_csv(spark, csv))))


@register("raw_material_peek")
def raw_material_peek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows after a load (the first by id, so that they are always the same)."""
    csv = _as_csv(_raw_material(Inputs(spark, sf_dir)), "peek-csv")
    return present(to_ntz(peek(batches_reference(read_batches_csv(spark, csv)))).select("batch_id", "milk_origin", "quality_grade"))


# --- named tables -------------------------------------------------------------------------------
def _published(spark: SparkSession, t: Inputs) -> TwinCatalog:
    catalog = _new_catalog(spark)
    catalog.publish(t.silver, t.gold_eq, t.gold_batch, t.gold_sus, t.registry)
    return catalog


@register("named_table_counts")
def named_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + S15: rows of silver, gold and the registry, read by name."""
    catalog = _published(spark, Inputs(spark, sf_dir))
    tables = ("silver_events", "equipment_metrics", "batch_yield", "sustainability_hourly", "equipment")
    counts = [catalog.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in tables]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


@register("named_equipment_status")
def named_equipment_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + J1: registry and newest window from bucketed tables, joined as they lie."""
    t = Inputs(spark, sf_dir)
    catalog = _new_catalog(spark)
    eq = catalog.save(t.gold_eq, "equipment_metrics", "equipment_id", ("window_5min",), ("event_date",))
    registry = catalog.save(t.registry, "equipment", "equipment_id")
    return present(serving.equipment_status(registry, eq, partitioned=True))


@register("named_what_if")
def named_what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + J3: requests and baselines from tables bucketed by batch, joined as they lie and scored."""
    t = Inputs(spark, sf_dir)
    catalog = _new_catalog(spark)
    batches = catalog.save(t.gold_batch, "batch_yield", "batch_id", ("plant_id",))
    ok, _ = whatif.validate_scenarios(_requests(t))
    return present(whatif.what_if(catalog.save(ok, "scenarios", "batch_id"), batches))


# --- parameterised SQL ----------------------------------------------------------------------------
@register("sql_machine_history")
def sql_machine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 + P12 as SQL with parameters: the machine of the smallest id, its last 30 days."""
    t = Inputs(spark, sf_dir)
    one = t.registry.agg(F.min("equipment_id")).first()[0]
    as_of = t.silver.agg(F.max("event_ts")).first()[0]
    if as_of is None or one is None:
        return present(serving.equipment_history(t.gold_eq, "", as_of=t.as_of))
    return present(sql_lookups.machine_history(spark, t.gold_eq, one, as_of, hours=720))


@register("sql_newest_of_batch")
def sql_newest_of_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 + P12 + T3 as SQL with parameters: the 60 newest events of one batch within 20 days."""
    t = Inputs(spark, sf_dir)
    as_of = t.silver.agg(F.max("event_ts")).first()[0]
    if as_of is None:
        return present(t.silver.limit(0).select("event_id", "event_ts", "event_type", "equipment_id", "batch_id", "temperature_c", "moisture_pct", "alarm_code"))
    return present(sql_lookups.newest_of_batch(spark, t.silver, "BATCH-7", as_of, hours=480))
