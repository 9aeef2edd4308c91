"""End-to-end example: land events, run the pipeline, ask the application's questions.

    python scripts/quickstart.py [sf_dir]

Replays the (adapted) events of ``sf_dir`` into a landing folder below the session's
checkpoint folder, drains bronze -> silver -> gold once, then serves a few endpoints
through ``TwinService``.  In production the landing folder receives the sensors' JSON
files and ``python -m sensortwin.streaming`` keeps the pipeline running.
"""

from __future__ import annotations

import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensortwin.service import TwinService  # noqa: E402
from sensortwin.session import build_session  # noqa: E402
from sensortwin.sources.adapter import load_events, load_registry  # noqa: E402
from sensortwin.sources.events import replay_to_landing  # noqa: E402
from sensortwin.streaming.pipeline import new_paths, run_available  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", 4, app_name="sensortwin-quickstart",
                          extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="sensortwin-quickstart-")})
    paths = new_paths(spark, "quickstart")
    replay_to_landing(load_events(spark, sf_dir), paths.landing, files=2)   # events arrive as JSON files
    run_available(spark, paths)                                            # bronze -> silver -> gold

    svc = TwinService(spark, paths, registry=load_registry(spark, sf_dir))
    as_of = svc.latest_event_time()   # reproducible "now" for a replay (default: current time)
    print("dashboard KPIs");        svc.dashboard_kpis().show(truncate=False)
    print("latest equipment");      svc.equipment_metrics().show(5, truncate=False)
    print("sustainability summary"); svc.sustainability_summary().show(truncate=False)
    print("live poll");             svc.stream_poll(as_of=as_of).show(5, truncate=False)
    batch = svc.simulate_batches().first()["batch_id"]
    scored, rejected = svc.simulate(batch, fat_delta_pct=0.5, heat_setting_c=90.0)
    print(f"what-if for {batch}")
    scored.select("batch_id", "plant_id", "sim_energy_kwh", "sim_quality_score", "recommendation").show(
        truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
