"""No event is lost or kept twice, no stale row stays, and shared folders are insisted on."""

from __future__ import annotations

import pytest
from twin_rows import make_raw, ts
from pyspark.sql import functions as F

from sensortwin import session
from sensortwin.operators.layers import to_silver
from sensortwin.sources.events import replay_to_landing
from sensortwin.sources.reference import write_table
from sensortwin.streaming.pipeline import bronze_stream, dedup_foreach_batch, new_paths, read_or_empty


def test_stream_dedup_keeps_late_distinct_events_and_drops_repeats(spark):
    paths = new_paths(spark, "test-lossless")
    out = paths.path("dedup")
    new = [{"event_id": f"n{i}", "event_ts": ts("2024-01-02T10:00:00").replace(second=i), "temperature_c": float(i)} for i in range(30)]
    late = [{"event_id": f"l{i}", "event_ts": ts("2024-01-01T08:00:00").replace(second=i)} for i in range(10)]
    same_time = [{"event_id": f"s{i}", "event_ts": ts("2024-01-01T08:00:00"), "equipment_id": "EQ-HOT"} for i in range(50)]
    for part in (new, new, late + same_time, new[:5] + late):
        replay_to_landing(make_raw(spark, part), paths.landing)
        q = (to_silver(bronze_stream(spark, paths.landing)).writeStream.foreachBatch(dedup_foreach_batch(out))
             .option("checkpointLocation", paths.ckpt("dedup")).trigger(availableNow=True).start())
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(out)
    assert got.count() == 41 and got.select("event_ts", "equipment_id", "event_type").distinct().count() == 41
    assert got.where("event_id = 'n7'").first()["temperature_c"] == 7.0
    assert got.where(F.col("equipment_id") == "EQ-HOT").first()["event_id"] == "s0"


def test_stream_dedup_batch_runs_again_without_change(spark):
    out = new_paths(spark, "test-again").path("dedup")
    run = dedup_foreach_batch(out)
    rows = to_silver(make_raw(spark, [{"event_id": f"e{i}", "event_ts": ts("2024-01-01T00:00:00").replace(second=i % 7)} for i in range(20)]))
    for epoch in (0, 0, 1, 1):
        run(rows, epoch)
        assert spark.read.parquet(out).count() == 7


def test_overwritten_table_keeps_no_stale_partition(spark):
    path = session.scratch_path(spark, "test-static")
    write_table(spark.createDataFrame([(1, "x"), (2, "y")], "v int, p string"), path, partition_by=["p"])
    write_table(spark.createDataFrame([(3, "x")], "v int, p string"), path, partition_by=["p"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(3, "x")]


def test_missing_table_is_empty_but_other_errors_are_raised(spark):
    schema = spark.range(1).schema
    assert read_or_empty(spark, session.scratch_path(spark, "nothing"), schema).count() == 0
    with pytest.raises(Exception, match="nosuchscheme"):
        read_or_empty(spark, "nosuchscheme://x/y", schema).count()


def test_local_folder_is_refused_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_session_settings_of_the_caller_stay(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12345")
    try:
        session.apply_session_defaults(spark)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "12345"
        assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
