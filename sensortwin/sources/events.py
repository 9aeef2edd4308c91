"""JSON-lines event sources and the landing-directory writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..schemas import CORRUPT_COLUMN, EVENT_COLUMNS, EVENT_SCHEMA_WITH_CORRUPT


def _json_reader(reader, max_files: int | None = None):
    r = (reader.schema(EVENT_SCHEMA_WITH_CORRUPT)
         .option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", CORRUPT_COLUMN))
    if max_files:
        r = r.option("maxFilesPerTrigger", int(max_files))
    return r


def read_events_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Incremental, typed, permissive read of a landing directory.

    A landing folder that does not exist yet (nothing has arrived) is created empty, so
    the stream starts and picks files up as they land.
    """
    try:
        return _json_reader(spark.readStream, max_files).json(path)
    except AnalysisException as e:
        if getattr(e, "getCondition", lambda: None)() != "PATH_NOT_FOUND":
            raise
        # an empty write creates the folder on any filesystem; its _SUCCESS marker is
        # ignored by file sources (names starting with "_")
        spark.createDataFrame([], "value string").write.mode("append").text(path)
        return _json_reader(spark.readStream, max_files).json(path)


def read_events_batch(spark: SparkSession, path: str) -> DataFrame:
    """The same source read once (backfills, tests)."""
    return _json_reader(spark.read).json(path)


def with_ingest_metadata(df: DataFrame, now=None) -> DataFrame:
    """``_ingested_at``, ``_source_file``, ``_file_modified_at`` from the hidden
    ``_metadata`` struct of a file source.  Frames that are not file scans get NULLs."""
    ingested = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    try:
        df.select("_metadata.file_path")  # analysis only: is this a file scan?
        src = F.col("_metadata.file_path")
        mod = F.col("_metadata.file_modification_time")
    except AnalysisException:  # not a file source: no hidden metadata column
        src = F.lit(None).cast("string")
        mod = F.lit(None).cast("timestamp")
    return df.select("*", ingested.alias("_ingested_at"), src.alias("_source_file"),
                     mod.alias("_file_modified_at"))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: (good, quarantine).

    A row is quarantined when silver would drop it: no ``event_id`` or an ``event_ts``
    that is missing or does not parse.  A row whose only problem is one badly typed
    field keeps that field NULL and stays good even though Spark also fills
    ``_corrupt_record`` for it.
    """
    ts = F.col("event_ts")
    parsed = ts if not isinstance(df.schema["event_ts"].dataType, T.StringType) else ts.try_cast("timestamp")
    ok = F.col("event_id").isNotNull() & parsed.isNotNull()
    good = df.filter(ok)
    bad = df.filter(~ok | ok.isNull())
    if CORRUPT_COLUMN in df.columns:
        good = good.drop(CORRUPT_COLUMN)
    return good, bad


def quarantine_reason(corrupt: str = CORRUPT_COLUMN) -> Column:
    """Why :func:`split_corrupt` set a row aside."""
    return (F.when(F.col(corrupt).isNotNull() & F.col("event_id").isNull(), F.lit("malformed"))
            .when(F.col("event_id").isNull(), F.lit("no event id")).otherwise(F.lit("unusable event time")))


def to_landing_json(df: DataFrame) -> DataFrame:
    """Raw events in the landing-file form: ``event_ts`` as ISO-8601 text with offset."""
    ts = df.schema["event_ts"].dataType
    if isinstance(ts, T.StringType):
        iso = F.col("event_ts")
    elif isinstance(ts, T.TimestampNTZType):  # zone-less wall time, UTC by convention
        iso = F.concat(F.date_format(F.col("event_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))
    else:  # an instant: rendered with the session zone's offset, so it parses back exactly
        iso = F.date_format(F.col("event_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    cols = [iso.alias("event_ts") if c == "event_ts" else F.col(c) for c in EVENT_COLUMNS]
    return df.select(*cols)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over all cores, for a replay of a table whose files or row groups are fewer, or hold one
    span of time each, so that a slice by time would be written by one task."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism))


def replay_to_landing(df: DataFrame, path: str, files: int | None = None, mode: str = "append",
                      rows_per_file: int = 1_000_000) -> None:
    """Write a table of events as JSON-lines files into a landing directory.

    Each partition of ``df`` writes its own files of at most ``rows_per_file`` events, so the
    number of writers follows the data (see :func:`spread`); ``files`` asks for an exact number instead.
    """
    out = to_landing_json(df)
    if files:
        out = out.repartition(files, "event_id")
    (out.write.mode(mode).option("ignoreNullFields", "true").option("maxRecordsPerFile", rows_per_file).json(path))
