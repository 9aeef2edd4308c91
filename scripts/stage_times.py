"""Summarize a Spark event log per query (job description): stages, tasks, task time,
shuffle read/write bytes, input bytes.  Usage: python scripts/stage_times.py <event-log folder>"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from pathlib import Path


def _lines(files):
    """Event-log lines of every (rolling) file; ``.zstd`` files are decompressed."""
    for f in files:
        if f.suffix == ".zstd":
            import io
            import zstandard
            with f.open("rb") as fh:
                yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8")
        else:
            yield from f.open()


def main() -> None:
    folder = Path(sys.argv[1])
    files = sorted(p for p in folder.rglob("*") if p.is_file() and p.name.startswith(("events_", "local-", "app-")))
    if not files:
        sys.exit(f"no event log in {folder}")
    stage_query: dict[int, str] = {}
    acc = defaultdict(lambda: defaultdict(int))
    current = "?"  # bench runs one query at a time
    for line in _lines(files):
        ev = json.loads(line)
        kind = ev.get("Event")
        if kind == "SparkListenerJobStart":
            desc = (ev.get("Properties") or {}).get("spark.job.description") or "?"
            if "runId" in desc or "\n" in desc or desc.startswith("Listing leaf files"):
                desc = current  # a micro-batch job: belongs to the query that started the stream
            else:
                current = desc
            for sid in ev.get("Stage IDs", []):
                stage_query[sid] = desc
        elif kind == "SparkListenerTaskEnd":
            q = stage_query.get(ev.get("Stage ID"), "?")
            m = ev.get("Task Metrics") or {}
            a = acc[q]
            a["tasks"] += 1
            a["task_ms"] += m.get("Executor Run Time", 0)
            a["shuffle_read"] += sum((m.get("Shuffle Read Metrics") or {}).get(k, 0)
                                     for k in ("Remote Bytes Read", "Local Bytes Read"))
            a["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
            a["input"] += (m.get("Input Metrics") or {}).get("Bytes Read", 0)
        elif kind == "SparkListenerStageCompleted":
            info = ev.get("Stage Info", {})
            acc[stage_query.get(info.get("Stage ID"), "?")]["stages"] += 1
    print("| query | stages | tasks | task s | input MB | shuffle write MB | shuffle read MB |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for q, a in sorted(acc.items()):
        print(f"| {q} | {a['stages']} | {a['tasks']} | {a['task_ms'] / 1000:.2f} | {a['input'] / 1e6:.1f} | "
              f"{a['shuffle_write'] / 1e6:.2f} | {a['shuffle_read'] / 1e6:.2f} |")


if __name__ == "__main__":
    main()
