"""The pipeline's tables by name: partitioned, bucketed and sorted in the session's catalog.

Tables that are joined by a key are bucketed and sorted by it, so that such joins read both sides as they lie,
without an exchange.  Tables are written below ``location`` (shared storage); a name is replaced as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 8


@dataclass(frozen=True)
class TwinCatalog:
    spark: SparkSession
    database: str
    location: str
    buckets: int = BUCKETS

    def create(self) -> TwinCatalog:
        """The namespace, if it is not there yet, with its tables below ``location``."""
        place = self.location.replace("'", "\\'")
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{place}'")
        return self

    def save(self, df: DataFrame, name: str, key: str | None = None, sort: tuple[str, ...] = (), partition_by: tuple[str, ...] = ()) -> DataFrame:
        """``df`` as the table ``name``; with a ``key`` in one file per bucket (and partition), sorted by it."""
        if key:
            df = df.repartition(self.buckets, key)
        w = df.write.mode("overwrite").format("parquet").option("path", f"{self.location.rstrip('/')}/{name}")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if key:
            w = w.bucketBy(self.buckets, key).sortBy(key, *sort)
        w.saveAsTable(self.name(name))
        return self.table(name)

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{table}`"

    def table(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def publish(self, silver: DataFrame, gold_eq: DataFrame, gold_batch: DataFrame, gold_sus: DataFrame, registry: DataFrame) -> None:
        """Silver, gold and the registry under their names: machines are bucketed for J1, batches for J3."""
        self.save(silver, "silver_events", partition_by=("event_date",))
        self.save(gold_eq, "equipment_metrics", "equipment_id", ("window_5min",), ("event_date",))
        self.save(gold_batch, "batch_yield", "batch_id", ("plant_id",))
        self.save(gold_sus, "sustainability_hourly", partition_by=("event_date",))
        self.save(registry, "equipment", "equipment_id")

    def drop(self) -> None:
        """Take the names out of the catalog; the files stay where they are."""
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.database}` CASCADE")
