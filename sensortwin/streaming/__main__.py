"""Run the pipeline continuously: ``python -m sensortwin.streaming --landing L --root R``.

Starts bronze, quarantine, silver, incremental gold and the live views (first alarms, feed buffer,
clustered silver) as Structured Streaming queries with a processing-time trigger (or drains what has landed with ``--available-now``)
and waits.  ``--root`` is the shared folder for tables and checkpoints; the landing
folder is where event files arrive.
"""

from __future__ import annotations

import argparse

from ..session import build_session
from .pipeline import (TwinPaths, run_available, start_alarms, start_bronze, start_buffer, start_clustered, start_gold, start_quarantine,
                       start_silver)

LIVE = (start_alarms, start_buffer, start_clustered)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="python -m sensortwin.streaming")
    ap.add_argument("--root", required=True, help="shared folder for tables and checkpoints")
    ap.add_argument("--landing", help="landing folder of JSON-lines event files (default ROOT/landing)")
    ap.add_argument("--trigger", default="1 minute", help="processing-time trigger, e.g. '30 seconds'")
    ap.add_argument("--max-files", type=int, default=None, help="max new files per micro-batch of each stream")
    ap.add_argument("--available-now", action="store_true", help="drain what has landed, then stop")
    ap.add_argument("--master", default=None)
    args = ap.parse_args(argv)

    spark = build_session(args.master, app_name="sensortwin-pipeline")
    paths = TwinPaths(args.root, args.landing)
    if args.available_now:
        run_available(spark, paths, live=LIVE)
        return
    queries = [start_bronze(spark, paths, args.trigger, args.max_files), start_quarantine(spark, paths, args.trigger),
               start_silver(spark, paths, args.trigger, args.max_files),
               start_gold(spark, paths, args.trigger, max_files=args.max_files),
               *[start(spark, paths, args.trigger) for start in LIVE]]
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for q in queries:
            if q.isActive:
                q.stop()


if __name__ == "__main__":
    main()
