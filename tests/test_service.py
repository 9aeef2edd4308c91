"""The endpoint facade over stored pipeline tables agrees with the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensortwin.operators import serving
from sensortwin.operators.alarms import alert_history
from sensortwin.plans.inputs import Inputs
from sensortwin.service import TwinService
from sensortwin.sources.events import replay_to_landing
from sensortwin.streaming.pipeline import new_paths, run_available, start_alarms, start_buffer, start_clustered

from twin_rows import SF_SMALL


def _ids(df, col="equipment_id"):
    return sorted(r[col] for r in df.collect())


def test_service_endpoints(spark):
    t = Inputs(spark, SF_SMALL)
    paths = new_paths(spark, "svc")
    replay_to_landing(t.raw, paths.landing, files=2)
    run_available(spark, paths, live=(start_alarms, start_buffer, start_clustered))
    svc = TwinService(spark, paths, registry=t.registry)
    assert _ids(svc.alert_board()) == _ids(alert_history(t.gold_eq))
    assert svc.feed_buffer().count() == 300
    one = t.registry.first().equipment_id
    assert svc.machine_events(one).count() == t.silver.where(F.col("equipment_id") == one).count()

    assert _ids(svc.equipment_metrics()) == _ids(serving.latest_equipment_metrics(t.gold_eq))
    assert svc.equipment_reference().count() == t.registry.count()
    assert _ids(svc.batch_yield(), "batch_id") == _ids(serving.batch_yield_report(t.gold_batch), "batch_id")
    assert svc.sustainability_summary().count() == t.summary.count()
    assert svc.batch_carbon_traceback().count() == serving.carbon_traceback(t.gold_batch).count()
    assert svc.simulate_batches().count() == 15

    as_of = svc.latest_event_time()
    assert svc.silver().select(as_of).first()[0] is not None
    poll = svc.stream_poll(as_of=as_of).collect()
    hist = svc.stream_history(as_of=as_of).collect()
    assert 1 <= len(poll) <= len(hist) <= 500
    eq_id = poll[0]["equipment_id"]
    assert svc.equipment_history(eq_id, hours=24 * 31, as_of=as_of).count() >= 1
    assert svc.sustainability(hours=0).count() == t.gold_sus.count()

    nodes, edges = svc.graph(as_of=as_of)
    assert nodes.filter(F.col("type") == "equipment").count() == t.registry.count()
    assert edges.count() <= 100

    batch = t.gold_batch.select("batch_id").first()[0]
    scored, rejected = svc.simulate(batch, 0.5, -0.2, 90.0)
    assert scored.count() == 1 and rejected.count() == 0          # one result, like the endpoint
    all_plants, _ = svc.simulate(batch, 0.5, -0.2, 90.0, one_per_batch=False)
    assert all_plants.count() == t.gold_batch.filter(F.col("batch_id") == batch).count()
    scored, rejected = svc.simulate("NO-SUCH-BATCH")
    assert scored.count() == 0 and rejected.count() == 0   # the 404 case: valid but unknown
    scored, rejected = svc.simulate(batch, 2.0)
    assert scored.count() == 0 and rejected.first()["reason"] == "fat_delta_pct out of range"

    # the views the UI derives
    assert svc.dashboard_kpis().count() == 1 and svc.sustainability_kpis().count() == 1
    assert svc.graph_stats(as_of=as_of).first()["equipment"] == t.registry.count()
    assert svc.alerts().count() == serving.latest_equipment_metrics(t.gold_eq).filter("alarm_count > 0").count()
    assert svc.equipment_grid().count() == svc.equipment_metrics().count()
    assert svc.batch_badges().count() == 20 and svc.plant_energy_share().count() == t.summary.count()
    assert svc.hourly_trend(hours=0).count() == t.gold_sus.select("hour_bucket").distinct().count()
    assert svc.carbon_insight().count() == 1
    assert svc.live_series(as_of=as_of).count() >= 1 and 1 <= svc.event_feed(as_of=as_of).count() <= 8
    from sensortwin.schemas import SCENARIO_SCHEMA
    reqs = spark.createDataFrame([(batch, 0.1, 0.1, 72.0), ("NO-SUCH-BATCH", 0.0, 0.0, 72.0), (batch, 0.0, 0.0, 99.0)],
                                 SCENARIO_SCHEMA)
    scored, rejected, unknown = svc.simulate_many(reqs)
    assert scored.select("batch_id").distinct().count() == 1
    assert [r["batch_id"] for r in unknown.collect()] == ["NO-SUCH-BATCH"]
    assert [r["reason"] for r in rejected.collect()] == ["heat_setting_c out of range"]
