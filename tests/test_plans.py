"""Plan properties of the registered queries, checked on their physical plans.

These encode the plan review (docs/PLANS.md) so that a change which, say, introduces a
cartesian product, loses the pushed null guard or re-joins the what-if grid fails here.
"""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from sensortwin.plans.catalog import queries

from twin_rows import SF_SMALL

BATCH = sorted(n for n in queries() if not n.startswith("stream_") and n != "json_replay_silver")
# partition-less windows are allowed only over bounded inputs (the <= 20 traceback rows,
# the per-batch partial rows of the batch-yield merge)
WINDOW_OK = {"carbon_traceback", "carbon_insight", "batch_yield_from_partials"}
# queries without silver's null guard: the registry listing, and bronze-level queries
# (bronze keeps every landed row by design; only silver filters)
NO_NULL_GUARD = {"what_if_rejected", "equipment_reference", "bronze_events", "bronze_row_count", "alarm_detection"}
# queries that read back what they wrote first (landing files, CSV, named and clustered tables)
STORED = {"ingest_metadata", "reference_load", "raw_material_batches", "raw_material_peek", "named_table_counts", "named_equipment_status",
          "named_what_if", "silver_clustered_lookup"}


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: _plan(queries()[n](spark, SF_SMALL)) for n in BATCH}


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if re.search(r"CartesianProduct|BroadcastNestedLoopJoin", p)]
    assert not bad, bad


def test_null_guard_pushed_to_the_events_scan(plans):
    bad = [n for n, p in plans.items() if n not in NO_NULL_GUARD | STORED and "IsNotNull(event_id)" not in p]
    assert not bad, bad


def test_what_if_grid_scores_without_a_join(plans):
    assert not re.search(r"Join", plans["what_if_grid"].split("===== Subqueries")[0])


def test_windows_only_over_bounded_inputs(plans):
    bad = [n for n, p in plans.items() if re.search(r"^\(\d+\) Window", p, re.M) and n not in WINDOW_OK]
    assert not bad, bad


def test_no_static_broadcast(plans):
    """Static (estimate-based) broadcast is off; AQE decides from measured sizes at run time."""
    bad = [n for n, p in plans.items() if re.search(r"^\(\d+\) BroadcastHashJoin", p, re.M)]
    assert not bad, bad


def test_small_join_side_is_broadcast_after_measurement(spark):
    """The registry ⟕ latest-window join plans as sort-merge and is switched to a broadcast
    hash join by AQE once the latest-window side has been measured small."""
    df = queries()["equipment_status"](spark, SF_SMALL)
    assert "BroadcastHashJoin" not in _plan(df)
    df.collect()
    final = _plan(df)
    assert "isFinalPlan=true" in final and "BroadcastHashJoin" in final
