"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the whole ``events`` (and ``supplier``) table of ``sf_dir`` through
the adapter and runs the library's operators on it; clock-relative ones use
``as_of = MAX(event_ts)`` as a scalar subquery.  Outputs go through ``present``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import alarms, graph, serving, whatif
from ..operators.gold import batch_partials, batch_yield_from_partials
from ..operators.layers import to_bronze, to_silver
from ..session import scratch_path
from ..sources.events import read_events_batch, replay_to_landing, split_corrupt
from .inputs import BusyInputs, Inputs
from .present import present

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    from . import source_queries as _sources  # noqa: F401  (registers queries of sources and named tables)
    from ..streaming import queries as _stream  # noqa: F401  (registers streaming queries)
    return dict(_REGISTRY)


def _q(fn, exact: bool = False):
    """Wrap ``fn(inputs) -> DataFrame`` as a registered-style callable."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(fn(Inputs(spark, sf_dir)), exact)
    run.__doc__ = fn.__doc__
    run.__name__ = fn.__name__
    run.__wrapped__ = fn
    return run


def _reg(name, exact: bool = False):
    def deco(fn):
        return register(name)(_q(fn, exact))
    return deco


def to_ntz(df: DataFrame) -> DataFrame:
    """Cast TIMESTAMP (session-zone) columns to TIMESTAMP_NTZ (exact under UTC)."""
    return df.select(*[F.col(f.name).cast(T.TimestampNTZType()).alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
                       for f in df.schema.fields])


# --- layers and sources -------------------------------------------------------

@_reg("bronze_events", exact=True)
def _bronze(t: Inputs):
    """Typed 31-column bronze projection."""
    return t.bronze


@_reg("bronze_row_count")
def _bronze_count(t: Inputs):
    """Row count after a load."""
    return t.bronze.agg(F.count(F.lit(1)).alias("row_count"))


@_reg("silver_events", exact=True)
def _silver(t: Inputs):
    """Cleaned, enriched silver events."""
    return t.silver


@register("json_replay_silver")
def json_replay_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12 -> S1/S2/S3 -> P1 -> P2-P8: events written as JSON-lines landing files, read back
    with the typed permissive reader, quarantine split, bronze parse of the ISO text
    timestamps, silver."""
    t = Inputs(spark, sf_dir)
    landing = scratch_path(spark, "landing")
    replay_to_landing(t.raw, landing)
    good, _bad = split_corrupt(read_events_batch(spark, landing))
    return present(to_ntz(to_silver(to_bronze(good))), exact=True)


# --- gold ---------------------------------------------------------------------

@_reg("equipment_metrics")
def _gold_eq(t: Inputs):
    """A1: 5-minute equipment metrics."""
    return t.gold_eq


@_reg("batch_yield")
def _gold_batch(t: Inputs):
    """A2: batch yield and quality."""
    return t.gold_batch


@_reg("batch_yield_from_partials")
def _gold_batch_partials(t: Inputs):
    """A2 via mergeable (batch, plant, date) partials: the incremental-refresh form."""
    return batch_yield_from_partials(batch_partials(t.silver), computed_at=False)


@_reg("sustainability_hourly")
def _gold_sus(t: Inputs):
    """A3: hourly sustainability."""
    return t.gold_sus


# --- equipment serving ---------------------------------------------------------

@_reg("latest_equipment_metrics")
def _latest(t: Inputs):
    """K18 + J2."""
    return serving.latest_equipment_metrics(t.gold_eq)


@_reg("equipment_history")
def _history(t: Inputs):
    """K17 + P12: every machine's windows of the last hour (the single-machine P11 form of
    the same function is unit-tested)."""
    return serving.equipment_history(t.gold_eq, None, hours=1, as_of=t.as_of)


@_reg("equipment_reference")
def _eq_ref(t: Inputs):
    """K19 + P14."""
    return serving.equipment_reference(t.registry)


@_reg("equipment_status")
def _eq_status(t: Inputs):
    """J1 + K3 + P16."""
    return serving.equipment_status(t.registry, t.gold_eq)


@_reg("equipment_grid")
def _eq_grid(t: Inputs):
    """K15 + K3."""
    return serving.equipment_grid(t.gold_eq)


# --- batches ---------------------------------------------------------------------

@_reg("batch_yield_report")
def _batch_report(t: Inputs):
    """T1 + P15."""
    return serving.batch_yield_report(t.gold_batch)


@_reg("simulatable_batches")
def _sim_batches(t: Inputs):
    """K16 + T2."""
    return serving.simulatable_batches(t.gold_batch)


@_reg("batch_badges")
def _badges(t: Inputs):
    """K5."""
    return serving.batch_badges(t.gold_batch)


@_reg("dashboard_kpis")
def _kpis(t: Inputs):
    """A6 + K6."""
    return serving.dashboard_kpis(t.gold_eq, t.gold_batch)


# --- sustainability -------------------------------------------------------------------

@_reg("sustainability_report")
def _sus_report(t: Inputs):
    """T10 + P12/P13 (720 hours)."""
    return serving.sustainability(t.gold_sus, as_of=t.as_of, hours=720)


@_reg("plant_summary")
def _plant_summary(t: Inputs):
    """A4."""
    return t.summary


@_reg("hourly_trend")
def _hourly_trend(t: Inputs):
    """A7."""
    return serving.hourly_trend(t.gold_sus, as_of=t.as_of, hours=720)


@_reg("sustainability_kpis")
def _sus_kpis(t: Inputs):
    """A9."""
    return serving.sustainability_kpis(t.summary)


@_reg("plant_energy_share")
def _share(t: Inputs):
    """W4."""
    return serving.plant_energy_share(t.summary)


@_reg("carbon_traceback")
def _traceback(t: Inputs):
    """W1 + W2."""
    return serving.carbon_traceback(t.gold_batch)


@_reg("carbon_insight")
def _insight(t: Inputs):
    """W3."""
    return serving.carbon_insight(serving.carbon_traceback(t.gold_batch))


# --- live feed ------------------------------------------------------------------------

@_reg("recent_events")
def _recent(t: Inputs):
    """T3 + P17 (30 s, 60 rows)."""
    return serving.recent_events(t.silver, as_of=t.as_of)


@_reg("event_history")
def _event_history(t: Inputs):
    """T4 (300 s, 500 rows, oldest first)."""
    return serving.event_history(t.silver, as_of=t.as_of)


@_reg("event_feed")
def _feed(t: Inputs):
    """T8 + K7."""
    return serving.event_feed(t.silver, as_of=t.as_of)


@_reg("live_series")
def _series(t: Inputs):
    """A8 over every event."""
    return serving.live_series(t.silver)


@_reg("event_dedup", exact=True)
def _dedup(t: Inputs):
    """D3 (batch)."""
    return serving.dedup_events(t.silver)


@_reg("event_rate")
def _rate(t: Inputs):
    """A11."""
    return serving.event_rate(t.silver)


@_reg("published_equipment_windows")
def _pub_eq(t: Inputs):
    """T9."""
    return serving.published_equipment_windows(t.gold_eq)


@_reg("published_batches")
def _pub_batches(t: Inputs):
    """T9."""
    return serving.published_batches(t.gold_batch)


@_reg("published_sustainability")
def _pub_sus(t: Inputs):
    """T9."""
    return serving.published_sustainability(t.gold_sus)


@_reg("published_events")
def _pub_events(t: Inputs):
    """T9."""
    return serving.published_events(t.silver)


# --- graph ------------------------------------------------------------------------------

def _nodes(t: Inputs):
    return graph.graph_nodes(t.registry, t.gold_eq, t.gold_batch)


def _edges(t: Inputs):
    return graph.graph_edges(t.silver, as_of=t.as_of)


@_reg("graph_nodes")
def _graph_nodes(t: Inputs):
    """K8 + K3 + K4 + D1."""
    return _nodes(t)


@_reg("graph_edges")
def _graph_edges(t: Inputs):
    """A5 + K9 + T5."""
    return _edges(t)


@_reg("graph_edges_resolved")
def _graph_resolved(t: Inputs):
    """Edges whose endpoints are both listed."""
    return graph.resolve_edges(_edges(t), graph.node_ids(t.registry, t.gold_batch))


@_reg("graph_dangling_edges")
def _graph_dangling(t: Inputs):
    """Edges with an unlisted endpoint, flagged."""
    return graph.dangling_edges(_edges(t), graph.node_ids(t.registry, t.gold_batch))


@_reg("graph_stats")
def _graph_stats(t: Inputs):
    """A10."""
    return graph.graph_stats(_nodes(t), _edges(t))


@_reg("alarm_impact")
def _alarm_impact(t: Inputs):
    """J6 over every batch and every edge of the recent window."""
    return graph.alarm_impact(graph.graph_nodes(t.registry, t.gold_eq, t.gold_batch, n=None),
                              graph.graph_edges(t.silver, as_of=t.as_of, n=None))


# --- what-if ------------------------------------------------------------------------------

def _what_if(t: Inputs):
    base = t.gold_batch.select("batch_id", "plant_id", *whatif.BASELINE_COLUMNS)
    ok, _rejected = whatif.validate_scenarios(whatif.scenario_grid(base))
    return whatif.score_scenarios(ok)


@_reg("what_if_grid")
def _what_if_grid(t: Inputs):
    """K12 -> K11 -> K10: every (batch, plant) scored on the full slider grid x heat presets.

    The grid is exploded from the batch rows themselves, so it carries the baseline:
    one aggregate of silver, no join back to it."""
    return _what_if(t)


@_reg("what_if_presets")
def _what_if_presets(t: Inputs):
    """K16 -> J3 + K10: the simulator's requests (listed batches x heat presets, by batch id
    only) joined to the batch table and scored; a batch in two plants scores twice (T7)."""
    requests = whatif.preset_requests(serving.simulatable_batches(t.gold_batch))
    return whatif.what_if(requests, t.gold_batch)


@_reg("what_if_scores")
def _what_if_scores(t: Inputs):
    """K13."""
    return whatif.what_if_scores(_what_if(t))


@_reg("what_if_compare")
def _what_if_compare(t: Inputs):
    """K14."""
    return whatif.what_if_compare(_what_if(t))


def _requests(t: Inputs) -> DataFrame:
    """Scenario requests in the endpoint's form, one per customer row: some name no batch or an
    unknown one, some leave the heat setting open, some lie out of range."""
    c = t.table("customer")
    k = F.col("c_custkey")
    return c.select(F.when(k % 11 != 0, F.concat(F.lit("BATCH-"), (k % 20).cast("string"))).alias("batch_id"),
                    F.col("c_mktsegment").alias("preset"),
                    ((F.col("c_nationkey") - 12).cast("double") / 10.0).alias("fat_delta_pct"),
                    ((k % 25 - 12).cast("double") / 10.0).alias("protein_delta_pct"),
                    F.when(k % 7 != 0, (k % 45 + 55).cast("double")).alias("heat_setting_c"))


@_reg("what_if_requests")
def _what_if_requests(t: Inputs):
    """K11 -> J3 + K10: a table of requests validated, joined to its batches and scored."""
    ok, _rejected = whatif.validate_scenarios(_requests(t))
    return whatif.what_if(ok, t.gold_batch)


@_reg("what_if_request_scores")
def _what_if_request_scores(t: Inputs):
    """K13 on requests: five scores per scored request."""
    return whatif.what_if_scores(_what_if_requests.__wrapped__(t))


@_reg("what_if_rejected")
def _what_if_rejected(t: Inputs):
    """The requests that validation rejects, with the reason."""
    return whatif.validate_scenarios(_requests(t))[1]


@_reg("what_if_unknown")
def _what_if_unknown(t: Inputs):
    """Valid requests that name a batch without a baseline."""
    return whatif.unknown_batches(whatif.validate_scenarios(_requests(t))[0], t.gold_batch)


@_reg("equipment_point_history")
def _point_history(t: Inputs):
    """P11 + P12: the last 30 days of one machine, the one of the smallest id."""
    one = t.registry.agg(F.min("equipment_id")).scalar()
    return serving.equipment_history(t.gold_eq.filter(F.col("equipment_id") == one), as_of=t.as_of, hours=720)


@_reg("sustainability_all_hours")
def _sustainability_all(t: Inputs):
    """T10 + P13: without a time filter."""
    return serving.sustainability(t.gold_sus, hours=0)


# --- alarms ----------------------------------------------------------------------------------

@_reg("alarm_detection")
def _detect(t: Inputs):
    """K1: rules applied to raw readings; the rows where a rule fired."""
    d = alarms.detect_alarms(t.bronze)
    return d.filter("rule_fired").select("event_id", "event_ts", "equipment_id", "equipment_type", "event_type",
                                         "alarm_code", "alarm_severity", "moisture_pct", "viscosity_cp",
                                         "water_liters")


@_reg("alerts_latest")
def _alerts(t: Inputs):
    """K2."""
    return alarms.alerts(t.gold_eq)


@_reg("alert_history")
def _alert_history(t: Inputs):
    """D4."""
    return alarms.alert_history(t.gold_eq)


# --- the same operators on a busy half hour ---------------------------------------------------

#: Queries whose limits, filters or branches the plain table leaves untouched.
BUSY = ("silver_events", "recent_events", "event_history", "event_feed", "event_dedup", "event_rate", "latest_equipment_metrics", "equipment_status",
        "equipment_grid", "dashboard_kpis", "alerts_latest", "alert_history", "graph_edges", "graph_dangling_edges", "alarm_impact")


def _register_busy(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(_REGISTRY[name].__wrapped__(BusyInputs(spark, sf_dir)), exact=name in ("silver_events", "event_dedup"))
    run.__doc__ = f"{_REGISTRY[name].__doc__.splitlines()[0]} (busy half hour)"
    register(f"busy_{name}")(run)


for _name in BUSY:
    _register_busy(_name)


@_reg("sustainability_recent")
def _sustainability_recent(t: Inputs):
    """T10 + P13: the last ten days, which leaves rows out."""
    return serving.sustainability(t.gold_sus, as_of=t.as_of, hours=240)


@register("busy_flow_gauge")
def _flow_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K15 with a gauge of 120 l/min, which many machines exceed."""
    return present(serving.equipment_grid(BusyInputs(spark, sf_dir).gold_eq, full_scale=120.0))
