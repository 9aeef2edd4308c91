"""Delta tables and the live views: mergeable partials, upserts, late events, chained state, buffer, alerts, layout."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensortwin.functions import bucket_start
from sensortwin.operators import partials as P
from sensortwin.operators.alarms import alert_history
from sensortwin.operators.gold import batch_partials, batch_yield, batch_yield_from_partials, equipment_metrics, sustainability_hourly
from sensortwin.operators.layers import to_bronze, to_silver
from sensortwin.operators.serving import event_rate
from sensortwin.plans.inputs import Inputs
from sensortwin.session import scratch_path
from sensortwin.sources.events import replay_to_landing
from sensortwin.streaming import views
from sensortwin.streaming.deltas import DeltaTable
from sensortwin.streaming.pipeline import BRONZE_SCHEMA, bronze_stream, delta_table, new_paths, run_available, silver_schema
from twin_rows import SF_SMALL, make_raw, ts


def _rounded(df):
    out = []
    for r in df.collect():
        d = {k: v for k, v in r.asDict().items() if k != "_computed_at"}
        out.append(tuple(sorted((k, repr(round(v, 6) if isinstance(v, float) else sorted(v) if isinstance(v, list) else v)) for k, v in d.items())))
    return sorted(out)


def _silver(spark, rows):
    return to_silver(to_bronze(make_raw(spark, rows)))


def _some_events(n=240, seed=2):
    r = random.Random(seed)
    kinds = ["sensor_reading", "alarm", "quality_check", "batch_start"]
    return [{"event_id": f"e{i}", "event_ts": ts("2024-01-01T10:00:00").replace(minute=r.randrange(60), second=r.randrange(60), day=r.choice([1, 1, 2])),
             "event_type": (kind := r.choice(kinds)), "equipment_id": r.choice(["EQ-1", "EQ-2", None]), "batch_id": r.choice(["B1", "B2", None]),
             "temperature_c": r.choice([None, r.uniform(60, 90)]), "energy_kwh": r.uniform(0, 300), "water_liters": r.uniform(0, 10),
             "moisture_pct": r.choice([None, r.uniform(2, 6)]), "first_time_right": r.choice([True, False, None]), "powder_output_kg_h": r.choice([0.0, 1800.0]),
             "alarm_code": r.choice(["MOISTURE_OUT_OF_SPEC", "WATER_OVERCONSUMPTION"]) if kind == "alarm" else None} for i in range(n)]


# -- partials -----------------------------------------------------------------------------------
def test_partials_of_any_slices_merge_to_gold(spark):
    silver = _silver(spark, _some_events())
    slices = [silver.filter(F.pmod(F.xxhash64("event_id"), F.lit(5)) == i) for i in range(5)]

    def whole(partial, merge):
        parts = [partial(s) for s in slices]
        left = merge(parts[0].union(parts[1]).union(parts[2]))   # merged partials are partials again
        return merge(left.union(parts[3]).union(parts[4]))

    assert _rounded(P.equipment_from_partials(whole(P.equipment_partials, P.merge_equipment_partials))) == _rounded(equipment_metrics(silver, computed_at=False))
    sus = P.sustainability_from_partials(whole(P.sustainability_partials, P.merge_sustainability_partials), whole(P.sustainability_members, P.merge_members))
    assert _rounded(sus) == _rounded(sustainability_hourly(silver, computed_at=False))
    assert _rounded(batch_yield_from_partials(whole(batch_partials, P.merge_batch_partials), computed_at=False)) == _rounded(batch_yield(silver, computed_at=False))


def test_sketches_stay_within_their_error_and_merge_by_day(spark):
    rows = spark.range(60_000).select(
        F.lit("PLANT-1").alias("plant_id"), F.lit("LINE-A").alias("line_id"), F.concat(F.lit("EQ-"), F.col("id") % 20_000).alias("equipment_id"),
        F.concat(F.lit("B-"), F.col("id") % 500).alias("batch_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("event_ts"),
        *[F.lit(None).cast("double").alias(c) for c in P._SUS_SUMS], F.lit("mixer").alias("equipment_type"), F.lit(False).alias("is_alarm"),
        F.lit(None).cast("string").alias("alarm_code")).withColumn("event_date", F.to_date("event_ts"))
    p = P.sustainability_partials(rows)
    day = P.distinct_estimates(p, "plant_id", "event_date").first()
    assert abs(day.equipment_estimate - 20_000) <= 3 * P.SKETCH_ERROR * 20_000 and abs(day.batch_estimate - 500) <= 3 * P.SKETCH_ERROR * 500 + 1
    members = P.sustainability_members(rows)
    assert members.where("kind = 'equipment'").select("member").distinct().count() == 20_000
    assert p.count() > 10  # hours, merged above without their events


# -- delta tables -------------------------------------------------------------------------------
def _sums(spark, fan=3):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    return DeltaTable(spark, scratch_path(spark, "deltas"), schema, lambda df: df.groupBy("k").agg(F.sum("v").alias("v")), ("k",), fan=fan)


def test_delta_table_compacts_by_powers_and_reads_each_batch_once(spark):
    t = _sums(spark)
    assert t.read().count() == 0
    for epoch in range(14):
        t.append(spark.range(4).select(F.col("id").alias("k"), F.lit(2**epoch).alias("v")), epoch)
        covered = sorted(x for tier, b in t.blocks() for x in range(b * 3**tier, (b + 1) * 3**tier))
        assert covered == list(range(epoch + 1))
        assert len(t.blocks()) <= 2 * 3  # fan - 1 of each tier
        assert {tuple(r) for r in t.read().collect()} == {(k, 2 ** (epoch + 1) - 1) for k in range(4)}
    assert (2, 0) in t.blocks()


def test_delta_table_takes_a_batch_that_runs_again(spark):
    t = _sums(spark)
    rows = spark.range(2).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v"))
    for epoch in (0, 0, 1, 2, 2, 2, 3):
        t.append(rows, epoch)
    assert {tuple(r) for r in t.read().collect()} == {(0, 4), (1, 4)}


def test_unfinished_block_is_not_read(spark):
    t = _sums(spark)
    for epoch in range(3):
        t.append(spark.range(1).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("v")), epoch)
    assert t.blocks() == [(1, 0)]
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{t.path}/tier=1/block=0/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)  # as a driver lost before the end would leave it
    assert t.blocks() == [(0, 0), (0, 1), (0, 2)] and t.read().first().v == 3


def test_gold_micro_batch_reads_only_its_own_rows(spark):
    """The plan that a micro-batch runs scans the batch alone: no silver folder and no gold deltas."""
    t = Inputs(spark, SF_SMALL)
    for partial in (P.equipment_partials, P.sustainability_partials, P.sustainability_members, batch_partials):
        plan = partial(t.silver)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1
    paths = new_paths(spark, "test-prune")
    replay_to_landing(t.raw, paths.landing, files=1)
    run_available(spark, paths, quarantine=False)
    day = t.silver.agg(F.max("event_date")).first()[0]
    gold = P.equipment_from_partials(delta_table(spark, paths, "equipment").read()).filter(F.col("event_date") == F.lit(day))
    assert f"EqualTo(event_date,{day})" in gold._jdf.queryExecution().executedPlan().toString()  # the filter reaches the deltas


# -- streams ------------------------------------------------------------------------------------
def _run(writer, paths, name, out=None):
    w = writer.option("checkpointLocation", paths.ckpt(name)).trigger(availableNow=True)
    q = w.start(out) if out else w.start()
    q.awaitTermination()
    assert q.exception() is None
    return q


def _metrics_upserted(spark, parts, delay):
    paths = new_paths(spark, "test-upsert")
    empty = to_silver(spark.createDataFrame([], BRONZE_SCHEMA))
    schema = views.equipment_metrics_stream(empty).schema
    keys, out, dropped = [*views.EQUIPMENT_KEYS, "window_5min", "event_date"], paths.path("t"), 0
    for part in parts:
        replay_to_landing(make_raw(spark, part), paths.landing)
        s = views.equipment_metrics_stream(to_silver(bronze_stream(spark, paths.landing)), delay)
        q = _run(s.writeStream.outputMode("update").foreachBatch(views.upsert_foreach_batch(out, schema, keys)), paths, "u")
        dropped += sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in p["stateOperators"])
    return views.upsert_table(spark, out, schema, keys).read().drop("epoch"), dropped


def test_watermarked_metrics_equal_batch_until_an_event_is_too_late(spark):
    first = [{"event_id": f"a{i}", "event_ts": ts(f"2024-01-01T10:0{i}:00"), "temperature_c": float(i)} for i in range(10)]
    within = [{"event_id": "b", "event_ts": ts("2024-01-01T10:08:30"), "temperature_c": 50.0, "event_type": "alarm", "alarm_code": "X"}]
    later = [{"event_id": "c", "event_ts": ts("2024-01-01T12:00:00"), "temperature_c": 1.0}]
    got, dropped = _metrics_upserted(spark, [first, within, later], "10 minutes")
    assert dropped == 0 and _rounded(got) == _rounded(equipment_metrics(_silver(spark, first + within + later), computed_at=False))

    too_late = [{"event_id": "d", "event_ts": ts("2024-01-01T10:01:30"), "temperature_c": 99.0}]
    got, dropped = _metrics_upserted(spark, [first, within, later, too_late], "10 minutes")
    assert dropped == 1  # one group of the late micro-batch
    assert _rounded(got) == _rounded(equipment_metrics(_silver(spark, first + within + later), computed_at=False))


def test_event_rate_on_the_stream_counts_repeats_once(spark):
    base = [{"event_id": f"e{i}", "event_ts": ts("2024-01-01T10:00:00").replace(second=i % 20), "equipment_id": f"EQ-{i % 3}"} for i in range(60)]
    again = [{**r, "event_id": f"{r['event_id']}x"} for r in base[:30]]
    beat = [{"event_id": "hb", "event_ts": ts("2024-01-01T11:00:00"), "equipment_id": "heartbeat"}]
    paths = new_paths(spark, "test-rate")
    for part in (base, again + base, beat):
        replay_to_landing(make_raw(spark, part), paths.landing)
        s = views.event_rate_stream(to_silver(bronze_stream(spark, paths.landing)))
        _run(s.writeStream.format("parquet").outputMode("append"), paths, "rate", paths.path("ticks"))
    got = {tuple(r) for r in spark.read.parquet(paths.path("ticks")).collect()}
    want = event_rate(_silver(spark, base + again))
    assert got == {tuple(r) for r in want.collect()} and len(got) == 4


@pytest.mark.parametrize("order", [1, 2])
def test_feed_buffer_is_the_newest_of_all_in_any_order(spark, order):
    r = random.Random(order)
    rows = [{"event_id": f"e{i}", "event_ts": ts("2024-01-01T10:00:00").replace(second=r.randrange(60)), "equipment_id": f"EQ-{r.randrange(4)}",
             "event_type": r.choice(["alarm", "sensor_reading"])} for i in range(200)]
    r.shuffle(rows)
    paths = new_paths(spark, "test-buffer")
    silver, seen = to_silver(spark.createDataFrame([], BRONZE_SCHEMA)).schema, []
    for at in range(0, 200, 50):
        seen += rows[at : at + 50]
        replay_to_landing(make_raw(spark, rows[at : at + 50]), paths.landing)
        _run(to_silver(bronze_stream(spark, paths.landing)).writeStream.foreachBatch(views.buffer_foreach_batch(paths.path("b"), silver, 20)), paths, "b")
        got = views.feed_buffer(spark, paths.path("b"), silver, 20).read().collect()
        keys = {}
        for x in seen:
            k = (x["event_ts"], x["equipment_id"], x["event_type"])
            keys[k] = min(keys.get(k, x["event_id"]), x["event_id"])
        want = sorted(keys, reverse=True)[:20]
        assert {(g.event_ts.replace(tzinfo=None), g.equipment_id, g.event_type, g.event_id) for g in got} == {(*k, keys[k]) for k in want}


def test_alert_board_is_the_same_whatever_the_order_of_arrival(spark):
    rows = [{"event_id": f"a{i}", "event_type": "alarm", "equipment_id": f"EQ-{i % 3}", "equipment_name": f"M{i % 3}", "temperature_c": 80.0 + i,
             "event_ts": ts("2024-01-01T10:00:00").replace(minute=(7 * i) % 60, second=i), "alarm_code": f"C{i}"} for i in range(30)]
    rows += [{"event_id": f"q{i}", "event_type": "alarm", "equipment_id": "EQ-1", "equipment_name": "M1", "event_ts": ts("2024-01-01T09:00:00"),
              "temperature_c": 91.25, "alarm_code": "Q"} for i in range(3)]
    boards = []
    for order in (rows, rows[::-1]):
        paths = new_paths(spark, "test-alerts")
        for at in range(0, len(order), 11):
            replay_to_landing(make_raw(spark, order[at : at + 11]), paths.landing)
            run_available(spark, paths, quarantine=False, tables=("equipment_metrics",))
            stream = spark.readStream.schema(silver_schema(spark)).parquet(paths.silver)
            _run(stream.writeStream.foreachBatch(views.alarms_foreach_batch(paths.path("a"), silver_schema(spark))), paths, "a")
        gold = P.equipment_from_partials(delta_table(spark, paths, "equipment").read())
        first = views.first_alarm_table(spark, paths.path("a"), silver_schema(spark)).read()
        boards.append(views.alert_board(first, gold))
    a, b = (_rounded(x) for x in boards)
    assert a == b and len(a) == 3
    hot = boards[0].where("equipment_id = 'EQ-1'").first()
    assert (hot.severity, hot.alarm_code, hot.alarm_count) == ("critical", "Q", 3)
    assert hot.message == "3 active alarms detected. Current temp 91.3°C — thermal runaway risk. Inspect immediately."
    history = alert_history(equipment_metrics(_silver(spark, rows), computed_at=False))
    drop = ("first_alarm_ts", "alarm_code", "alarm_severity")
    assert _rounded(boards[0].drop(*drop)) == _rounded(history)
    assert boards[0].where("severity = 'warning'").first().message is None


def _rows_out_of_scan(df):
    """Rows that the file scan of an executed frame handed on, after row groups were skipped."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(p):
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if "FileSourceScanExec" in p.getClass().getName():
            found.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(plan)
    return found


def test_lookup_in_the_clustered_layout_skips_row_groups(spark):
    n = 120_000
    rows = spark.range(n).select(F.col("id").cast("string").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("event_ts"),
                                 F.concat(F.lit("EQ-"), F.pmod(F.xxhash64("id"), F.lit(997))).alias("equipment_id"),
                                 F.concat(F.lit("PLANT-"), F.pmod(F.xxhash64("id"), F.lit(997)) % 3).alias("plant_id"), F.lit("mixer").alias("equipment_type"),
                                 F.md5(F.col("id").cast("string")).alias("payload"))
    table = views.clustered_table(spark, scratch_path(spark, "clustered"), rows.schema, row_group_bytes=64 << 10)
    for epoch in range(2):
        table.append(rows.where(f"cast(event_id as long) % 2 = {epoch}"), epoch)
    one = table.read().where("equipment_id = 'EQ-500'")
    want = rows.where("equipment_id = 'EQ-500'").count()
    assert one.count() == want > 0
    assert sum(_rows_out_of_scan(one)) < n / 10                       # all but a few row groups are skipped
    absent = table.read().where("equipment_id = 'EQ-5000'")           # within the range of ids, in no Bloom filter
    assert absent.count() == 0 and sum(_rows_out_of_scan(absent)) < n / 10


def test_first_alarm_window_is_the_gold_window(spark):
    silver = _silver(spark, _some_events())
    first = P.first_alarms(silver)
    assert first.select(bucket_start("event_ts", "5 minutes")).count() == first.select("equipment_id").distinct().count()
