"""Stream = batch, malformed input, restarts."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import functions as F

from sensortwin.operators.gold import batch_yield, equipment_metrics, sustainability_hourly
from sensortwin.plans.inputs import Inputs
from sensortwin.session import local_path, scratch_path
from sensortwin.sources.events import read_events_batch, replay_to_landing, split_corrupt
from sensortwin.streaming.pipeline import new_paths, read_gold, read_silver, rebuild_all, run_available

from twin_rows import SF_SMALL


def _rows(df, keys, drop=("_computed_at",)):
    out = {}
    for r in df.collect():
        d = {k: v for k, v in r.asDict().items() if k not in drop}
        if "window_5min" in d or "hour_bucket" in d or "batch_first_seen" in d:
            d = {k: (v.replace(tzinfo=None) if hasattr(v, "tzinfo") and hasattr(v, "hour") else v)
                 for k, v in d.items()}
        out[tuple(d[k] for k in keys)] = d
    return out


def _same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            if isinstance(v, float) and w is not None:
                assert math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-9), (k, c, v, w)
            else:
                assert v == w, (k, c, v, w)


def test_stream_equals_batch_with_late_instalments(spark):
    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "test-twin")
    # latest events first, then the older ones: every later instalment is late data
    newest = t.raw.filter(F.col("event_ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    older = t.raw.filter(F.col("event_ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    for part in (newest, older.filter(F.col("event_id").cast("long") % 2 == 0),
                 older.filter(F.col("event_id").cast("long") % 2 == 1)):
        replay_to_landing(part, paths.landing, files=2)
        run_available(spark, paths)
    gold = read_gold(spark, paths)
    batch_silver = read_silver(spark, paths)
    assert batch_silver.count() == t.silver.count()
    eq_keys = ("equipment_id", "equipment_name", "equipment_type", "line_id", "plant_id", "window_5min")
    _same(_rows(gold["equipment_metrics"].withColumn("window_5min", F.col("window_5min").cast("timestamp_ntz")),
                eq_keys),
          _rows(equipment_metrics(t.silver, computed_at=False), eq_keys))
    sus_keys = ("plant_id", "line_id", "hour_bucket")
    _same(_rows(gold["sustainability_hourly"].withColumn("hour_bucket", F.col("hour_bucket").cast("timestamp_ntz")),
                sus_keys),
          _rows(sustainability_hourly(t.silver, computed_at=False), sus_keys))
    b_keys = ("batch_id", "plant_id")
    _same(_rows(gold["batch_yield"].withColumn("batch_first_seen", F.col("batch_first_seen").cast("timestamp_ntz"))
                .withColumn("batch_last_seen", F.col("batch_last_seen").cast("timestamp_ntz")), b_keys),
          _rows(batch_yield(t.silver, computed_at=False), b_keys))

    # newest-partition lookups on the stored, date-partitioned tables agree with full scans
    from sensortwin.functions import latest_ts
    from sensortwin.operators.serving import latest_window
    assert (batch_silver.select(latest_ts(batch_silver, partitioned=True)).first()[0]
            == batch_silver.select(latest_ts(batch_silver)).first()[0])
    stored_eq = gold["equipment_metrics"]
    assert (sorted(r["equipment_id"] for r in latest_window(stored_eq, partitioned=True).collect())
            == sorted(r["equipment_id"] for r in latest_window(stored_eq).collect()))

    # a full refresh (X9) over the same landing files gives the same gold
    fresh = rebuild_all(spark, paths, "test-rebuild", max_files=2)  # in bounded, restartable steps
    again = read_gold(spark, fresh)
    _same(_rows(again["equipment_metrics"], eq_keys), _rows(gold["equipment_metrics"], eq_keys))
    _same(_rows(again["batch_yield"], b_keys), _rows(gold["batch_yield"], b_keys))
    _same(_rows(again["sustainability_hourly"], sus_keys), _rows(gold["sustainability_hourly"], sus_keys))


def test_malformed_lines_are_quarantined_not_fatal(spark):
    landing = local_path(scratch_path(spark, "bad-landing"))
    os.makedirs(landing, exist_ok=True)
    good = {"event_id": "g1", "event_ts": "2026-03-01T06:00:00.123456+00:00", "event_type": "sensor_reading",
            "temperature_c": 70.5}
    lines = [
        json.dumps(good),
        "{this is not json",
        json.dumps({**good, "event_id": "g2", "temperature_c": "hot"}),  # wrong type: field NULL, row kept
        json.dumps({**good, "event_id": None}),
        json.dumps({**good, "event_id": "b3", "event_ts": "yesterday"}),
    ]
    with open(os.path.join(landing, "part-0.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    open(os.path.join(landing, "part-1.json"), "w").close()  # empty file
    raw = read_events_batch(spark, landing)
    ok, bad = split_corrupt(raw)
    ok_rows = {r["event_id"]: r for r in ok.collect()}
    assert set(ok_rows) == {"g1", "g2"}
    assert ok_rows["g2"]["temperature_c"] is None and ok_rows["g1"]["temperature_c"] == 70.5
    assert bad.count() == 3

    paths = new_paths(spark, "test-bad")
    os.makedirs(local_path(paths.landing), exist_ok=True)
    with open(os.path.join(local_path(paths.landing), "part-0.json"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    run_available(spark, paths)
    assert spark.read.parquet(paths.bronze).count() == 5   # bronze keeps every line, as landed
    assert read_silver(spark, paths).count() == 2
    assert spark.read.parquet(paths.quarantine).count() == 3


def test_gold_recovers_from_a_failed_micro_batch(spark):
    """A micro-batch that dies after writing part of gold is re-run on restart from the checkpoint; it writes
    the same deltas again, so gold ends up exact."""
    from sensortwin.streaming import pipeline as P

    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "test-fail")
    replay_to_landing(t.raw, paths.landing, files=2)
    run_available(spark, paths, gold=False)

    def failing(batch_df, epoch_id):
        P.gold_foreach_batch(paths, tables=("equipment_metrics",))(batch_df, epoch_id)
        raise RuntimeError("executor lost mid-batch")

    src = spark.readStream.schema(P.silver_schema(spark)).parquet(paths.silver)
    q = (src.writeStream.foreachBatch(failing).option("checkpointLocation", paths.ckpt("gold"))
         .trigger(availableNow=True).start())
    try:
        q.awaitTermination()
    except Exception:  # noqa: BLE001  (the injected failure surfaces here)
        pass
    assert q.exception() is not None
    P._await(P.start_gold(spark, paths))  # restart: the uncommitted batch runs again
    got = read_gold(spark, paths)["equipment_metrics"].withColumn(
        "window_5min", F.col("window_5min").cast("timestamp_ntz"))
    keys = ("equipment_id", "equipment_name", "equipment_type", "line_id", "plant_id", "window_5min")
    _same(_rows(got, keys), _rows(equipment_metrics(t.silver, computed_at=False), keys))


def test_salted_stream_dedup_handles_a_hot_group_of_copies(spark):
    """A third of the rows are copies of one event; the salted two-stage dedup keeps every
    distinct key exactly once, like the plain one."""
    from sensortwin.streaming.pipeline import dedup_stream
    from twin_rows import make_raw, ts

    base = [{"event_id": f"u{i}", "event_ts": ts("2024-01-01T00:00:00").replace(second=i % 60, minute=i // 60),
             "temperature_c": float(i)} for i in range(200)]
    hot = [{"event_id": f"c{i}", "event_ts": ts("2024-01-01T00:00:30"), "equipment_id": "EQ-HOT"}
           for i in range(100)]
    raw = make_raw(spark, base + hot)
    for salt in (1, 4):
        paths = new_paths(spark, f"test-salt{salt}")
        replay_to_landing(raw, paths.landing, files=4)
        from sensortwin.operators.layers import to_silver
        from sensortwin.streaming.pipeline import bronze_stream
        out = paths.path("dedup")
        q = (dedup_stream(to_silver(bronze_stream(spark, paths.landing)), salt_buckets=salt)
             .select("event_ts", "equipment_id", "event_type").writeStream.format("parquet")
             .option("checkpointLocation", paths.ckpt("dedup")).trigger(availableNow=True).start(out))
        q.awaitTermination()
        got = spark.read.parquet(out)
        assert got.count() == 201
        assert got.filter(F.col("equipment_id") == "EQ-HOT").count() == 1


def test_continuous_trigger_picks_up_new_files(spark):
    """The four streams running with a processing-time trigger, as in production: files that
    land while they run reach gold without a restart."""
    import time as _time

    from sensortwin.streaming.pipeline import start_bronze, start_gold, start_quarantine, start_silver

    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "test-continuous")
    first, second = (t.raw.filter(F.col("event_id").cast("long") % 2 == i) for i in (0, 1))
    replay_to_landing(first, paths.landing, files=1)
    qs = [start(spark, paths, "1 second") for start in (start_bronze, start_quarantine, start_silver, start_gold)]
    try:
        replay_to_landing(second, paths.landing, files=1)   # lands while the streams run
        want = t.gold_eq.count()
        deadline = _time.time() + 120
        got = -1
        while _time.time() < deadline:
            got = read_gold(spark, paths, "equipment_metrics").count()
            if got == want and read_silver(spark, paths).count() == t.silver.count():
                break
            _time.sleep(2)
        assert got == want
        assert all(q.isActive for q in qs) and all(q.exception() is None for q in qs)
    finally:
        for q in qs:
            q.stop()


def test_max_files_per_trigger_splits_the_backlog(spark):
    from sensortwin.streaming.pipeline import start_bronze

    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "test-maxfiles")
    replay_to_landing(t.raw, paths.landing, files=4)
    q = start_bronze(spark, paths, max_files=1)
    q.awaitTermination()
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 4 and sum(p["numInputRows"] for p in batches) == t.raw.count()
    assert spark.read.parquet(paths.bronze).count() == t.raw.count()


def test_pipeline_starts_before_the_first_file_lands(spark):
    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "test-nolanding")
    run_available(spark, paths)                      # no landing folder yet: nothing to do, no error
    assert read_gold(spark, paths, "equipment_metrics").count() == 0
    replay_to_landing(t.raw, paths.landing, files=2)
    run_available(spark, paths)
    assert read_gold(spark, paths, "equipment_metrics").count() == t.gold_eq.count()


def test_event_time_offsets_are_normalised_to_utc(spark):
    landing = local_path(scratch_path(spark, "tz-landing"))
    os.makedirs(landing, exist_ok=True)
    rows = [{"event_id": "a", "event_ts": "2026-03-01T01:30:00+02:00", "event_type": "sensor_reading"},
            {"event_id": "b", "event_ts": "2026-03-01T01:30:00-05:00", "event_type": "sensor_reading"},
            {"event_id": "c", "event_ts": "2026-03-01T01:30:00", "event_type": "sensor_reading"}]
    with open(os.path.join(landing, "part-0.json"), "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows) + "\n")
    from sensortwin.operators.layers import to_bronze, to_silver
    s = {r["event_id"]: r for r in to_silver(to_bronze(read_events_batch(spark, landing))).collect()}
    assert (str(s["a"]["event_date"]), s["a"]["event_hour"]) == ("2026-02-28", 23)
    assert (str(s["b"]["event_date"]), s["b"]["event_hour"]) == ("2026-03-01", 6)
    assert (str(s["c"]["event_date"]), s["c"]["event_hour"]) == ("2026-03-01", 1)


def test_replay_deals_a_time_sorted_file_over_all_cores(spark, tmp_path):
    """A table of one file in time order: each slice by time is written by several tasks, and whole."""
    from datetime import datetime, timedelta

    from sensortwin.plans.inputs import Inputs
    from sensortwin.streaming.queries import _in_time_order

    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i % 7, "view", 1.0, '{"k": 5}') for i in range(300)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    parts = _in_time_order(Inputs(spark, str(tmp_path)))
    seen = []
    for i, part in enumerate(parts):
        replay_to_landing(part, str(tmp_path / f"landing{i}"))
        files = list((tmp_path / f"landing{i}").glob("part-*.json"))
        assert sum(1 for f in files if f.stat().st_size) > 1
        seen += [int(r[0]) for r in spark.read.json(str(tmp_path / f"landing{i}")).select("event_id").collect()]
    assert sorted(seen) == list(range(300))
