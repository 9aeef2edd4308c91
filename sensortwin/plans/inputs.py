"""Lazily defined tables of one data directory: raw -> bronze -> silver -> gold.

Nothing here runs a job; each property is a DataFrame plan over the parquet files,
so every query that uses it gets Catalyst's pruning and pushdown into the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import latest_ts
from ..operators.gold import batch_yield, equipment_metrics, sustainability_hourly
from ..operators.layers import to_bronze, to_silver
from ..operators.serving import plant_summary
from ..sources.adapter import busy_events, load_events, load_registry, read_table, sensor_events
from ..sources.events import spread


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return load_events(self.spark, self.sf_dir)

    @cached_property
    def replayed(self) -> DataFrame:
        """``raw`` for a replay: the narrow rows are dealt out (filters pass below that), then each task maps and writes its share."""
        return sensor_events(spread(self.table("events")))

    @cached_property
    def bronze(self) -> DataFrame:
        return to_bronze(self.raw)

    @cached_property
    def silver(self) -> DataFrame:
        return to_silver(self.bronze)

    @cached_property
    def registry(self) -> DataFrame:
        return load_registry(self.spark, self.sf_dir)

    @cached_property
    def gold_eq(self) -> DataFrame:
        return equipment_metrics(self.silver, computed_at=False)

    @cached_property
    def gold_batch(self) -> DataFrame:
        return batch_yield(self.silver, computed_at=False)

    @cached_property
    def gold_sus(self) -> DataFrame:
        return sustainability_hourly(self.silver, computed_at=False)

    @cached_property
    def summary(self) -> DataFrame:
        return plant_summary(self.gold_sus)

    @cached_property
    def as_of(self) -> Column:
        """``as_of = MAX(event_ts)`` as a scalar subquery (reproducible "now")."""
        return latest_ts(self.silver)


class BusyInputs(Inputs):
    """The same tables as a busy half hour (``busy_events``)."""

    @cached_property
    def raw(self) -> DataFrame:
        return sensor_events(busy_events(self.table("events")))
