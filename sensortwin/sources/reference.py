"""Dimension tables and table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EQUIPMENT_SCHEMA, RAW_MATERIAL_BATCH_SCHEMA


def read_reference_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header and an explicit schema (UTF-8; no inference pass over the data)."""
    return (spark.read.option("header", "true").option("encoding", "UTF-8")
            .option("mode", "PERMISSIVE").schema(schema).csv(path))


def read_equipment_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_reference_csv(spark, path, EQUIPMENT_SCHEMA)


def read_batches_csv(spark: SparkSession, path: str) -> DataFrame:
    return read_reference_csv(spark, path, RAW_MATERIAL_BATCH_SCHEMA)


def create_namespace(spark: SparkSession, name: str) -> None:
    """``CREATE DATABASE IF NOT EXISTS``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def load_reference(spark: SparkSession, path: str, schema, table: str,
                   fmt: str = "parquet") -> DataFrame:
    """CSV -> managed table, replacing any previous content (CTAS semantics)."""
    df = read_reference_csv(spark, path, schema)
    df.write.mode("overwrite").format(fmt).saveAsTable(table)
    return spark.table(table)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """Write a table; ``overwrite`` replaces it as a whole, whatever the session's partition mode."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def peek(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``SELECT * ... LIMIT n`` peek after a load."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """The row count after a load, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def batches_reference(batches: DataFrame) -> DataFrame:
    """The raw-material batch listing, ordered by batch id."""
    return batches.orderBy("batch_id")
