"""The application's read endpoints as DataFrame methods over the pipeline's stored tables.

One method per endpoint of the application's API, each returning a lazy DataFrame over
the gold / silver tables written by ``streaming.pipeline`` (date-partitioned, so the
latest-window and recency lookups prune to the newest dates).  No web server: callers
collect or write the result.  ``as_of`` defaults to the current time, as in the API.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import latest_ts, since
from .operators import alarms, graph, serving, whatif
from .schemas import SCENARIO_SCHEMA
from .streaming.pipeline import TwinPaths, read_alerts, read_buffer, read_clustered, read_gold, read_silver


class TwinService:
    def __init__(self, spark: SparkSession, paths: TwinPaths, registry: DataFrame | None = None,
                 batches: DataFrame | None = None):
        self.spark = spark
        self.paths = paths
        self.registry = registry      # equipment dimension (name/type columns as in the CSV)
        self.batches = batches        # raw-material batch dimension

    # tables ---------------------------------------------------------------------------------
    def gold_eq(self) -> DataFrame:
        return read_gold(self.spark, self.paths, "equipment_metrics")

    def gold_batch(self) -> DataFrame:
        return read_gold(self.spark, self.paths, "batch_yield")

    def gold_sus(self) -> DataFrame:
        return read_gold(self.spark, self.paths, "sustainability_hourly")

    def silver(self) -> DataFrame:
        return read_silver(self.spark, self.paths)

    # equipment ------------------------------------------------------------------------------
    def equipment_metrics(self) -> DataFrame:
        return serving.latest_equipment_metrics(self.gold_eq(), partitioned=True)

    def equipment_history(self, equipment_id: str, hours: int = 1, as_of=None) -> DataFrame:
        return serving.equipment_history(self.gold_eq(), equipment_id, hours, as_of).drop("equipment_id")

    def equipment_reference(self) -> DataFrame:
        return serving.equipment_reference(self._registry())

    # batches ---------------------------------------------------------------------------------
    def batch_yield(self) -> DataFrame:
        return serving.batch_yield_report(self.gold_batch())

    def batches_reference(self) -> DataFrame:
        if self.batches is None:
            raise ValueError("no raw-material batch table given")
        return self.batches.orderBy("batch_id")

    # sustainability ------------------------------------------------------------------------------
    def sustainability(self, hours: int = 720, as_of=None) -> DataFrame:
        return serving.sustainability(self.gold_sus(), as_of=as_of, hours=hours)

    def sustainability_summary(self) -> DataFrame:
        return serving.plant_summary(self.gold_sus())

    def batch_carbon_traceback(self) -> DataFrame:
        return serving.carbon_traceback(self.gold_batch())

    # graph ------------------------------------------------------------------------------------------
    def graph(self, as_of=None) -> tuple[DataFrame, DataFrame]:
        nodes = graph.graph_nodes(self._registry(), self.gold_eq(), self.gold_batch(), partitioned=True)
        edges = graph.graph_edges(self.silver(), as_of=as_of)
        return nodes, edges

    # simulator -------------------------------------------------------------------------------------
    def simulate(self, batch_id: str, fat_delta_pct: float | None = None, protein_delta_pct: float | None = None,
                 heat_setting_c: float | None = None, one_per_batch: bool = True) -> tuple[DataFrame, DataFrame]:
        """One request, like the endpoint: (scored row -- empty means unknown batch, rejected
        request rows).  One baseline per batch (smallest plant id) unless ``one_per_batch=False``."""
        req = self.spark.createDataFrame([(batch_id, fat_delta_pct, protein_delta_pct, heat_setting_c)],
                                         SCENARIO_SCHEMA)
        ok, rejected = whatif.validate_scenarios(req)
        return whatif.what_if(ok, self.gold_batch(), one_per_batch=one_per_batch), rejected

    def simulate_many(self, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Many requests at once: (scored, rejected, unknown batch)."""
        ok, rejected = whatif.validate_scenarios(requests)
        gb = self.gold_batch()
        return whatif.what_if(ok, gb), rejected, whatif.unknown_batches(ok, gb)

    def simulate_batches(self) -> DataFrame:
        return serving.simulatable_batches(self.gold_batch())

    # live feed ------------------------------------------------------------------------------------------
    def stream_poll(self, as_of=None) -> DataFrame:
        return serving.recent_events(self.silver(), as_of, C.POLL_SECONDS, C.POLL_LIMIT)

    def stream_history(self, as_of=None) -> DataFrame:
        return serving.event_history(self.silver(), as_of, C.HISTORY_SECONDS, C.HISTORY_LIMIT)

    # views the UI derives from the endpoints ------------------------------------------------------------
    def dashboard_kpis(self) -> DataFrame:
        return serving.dashboard_kpis(self.gold_eq(), self.gold_batch(), partitioned=True)

    def alerts(self) -> DataFrame:
        return alarms.alerts(self.gold_eq(), partitioned=True)

    def alert_board(self) -> DataFrame:
        """Every machine that ever raised an alarm, with its first one."""
        return read_alerts(self.spark, self.paths)

    def feed_buffer(self) -> DataFrame:
        """The newest events of the live feed."""
        return read_buffer(self.spark, self.paths)

    def machine_events(self, equipment_id: str) -> DataFrame:
        """All events of one machine, from the clustered copy of silver."""
        return read_clustered(self.spark, self.paths).where(F.col("equipment_id") == F.lit(equipment_id)).orderBy("event_ts", "event_id")

    def equipment_grid(self) -> DataFrame:
        return serving.equipment_grid(self.gold_eq(), partitioned=True)

    def batch_badges(self) -> DataFrame:
        return serving.batch_badges(self.gold_batch())

    def sustainability_kpis(self) -> DataFrame:
        return serving.sustainability_kpis(self.sustainability_summary())

    def plant_energy_share(self) -> DataFrame:
        return serving.plant_energy_share(self.sustainability_summary())

    def hourly_trend(self, hours: int = 720, as_of=None) -> DataFrame:
        return serving.hourly_trend(self.gold_sus(), as_of=as_of, hours=hours)

    def carbon_insight(self) -> DataFrame:
        return serving.carbon_insight(self.batch_carbon_traceback())

    def graph_stats(self, as_of=None) -> DataFrame:
        nodes, edges = self.graph(as_of)
        return graph.graph_stats(nodes, edges)

    def live_series(self, as_of=None) -> DataFrame:
        """Per-second averages over the feed's history window."""
        s = self.silver()
        return serving.live_series(since(s, "event_ts", as_of, seconds=C.HISTORY_SECONDS, date_col="event_date"))

    def event_feed(self, as_of=None) -> DataFrame:
        return serving.event_feed(self.silver(), as_of)

    # ----------------------------------------------------------------------------------------------------
    def _registry(self) -> DataFrame:
        if self.registry is None:
            raise ValueError("no equipment registry given")
        return self.registry

    def latest_event_time(self):
        """A reproducible ``as_of`` for stored data: the newest event, newest partition only."""
        return latest_ts(self.silver(), partitioned=True)


__all__ = ["TwinService"]
