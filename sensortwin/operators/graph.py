"""Batch -> equipment property graph as two DataFrames.

Only one hop is ever taken, so the graph is plain relational data: a node table and an
edge table, combined with equi-joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import since
from .serving import equipment_status, newest_batches

NODE_COLUMNS = ("id", "type", "label", "equipment_type", "plant_id", "line_id", "avg_temperature_c",
                "total_energy_kwh", "alarm_count", "avg_moisture_pct", "avg_protein_pct", "avg_fat_pct",
                "ftr_rate_pct", "moisture_compliance_pct", "status")


def batch_status(compliance, threshold: float = C.BATCH_STATUS_COMPLIANCE):
    """K4: warning when compliance < 90, where 0 and NULL both count as 100 (ok)."""
    c = F.coalesce(F.nullif(compliance, F.lit(0.0)), F.lit(100.0))
    return F.when(c < threshold, F.lit("warning")).otherwise(F.lit("ok"))


def equipment_nodes(registry: DataFrame, gold_eq: DataFrame, partitioned: bool = False) -> DataFrame:
    s = equipment_status(registry, gold_eq, partitioned)
    return s.select(F.col("equipment_id").alias("id"), F.lit("equipment").alias("type"),
                    F.col("equipment_name").alias("label"), "equipment_type", "plant_id", "line_id",
                    "avg_temperature_c", "total_energy_kwh", "alarm_count", "status")


def batch_nodes(gold_batch: DataFrame, n: int | None = C.GRAPH_BATCHES) -> DataFrame:
    """Batch nodes of the ``n`` newest batches (the page's limit), or of all with ``n=None``."""
    z = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    b = gold_batch if n is None else newest_batches(gold_batch, n)
    return b.select(F.col("batch_id").alias("id"), F.lit("batch").alias("type"), F.col("batch_id").alias("label"),
                    "plant_id", F.array_join("line_ids", ",").alias("line_id"),
                    z("avg_moisture_pct").alias("avg_moisture_pct"), z("avg_protein_pct").alias("avg_protein_pct"),
                    z("avg_fat_pct").alias("avg_fat_pct"), z("ftr_rate_pct").alias("ftr_rate_pct"),
                    z("moisture_compliance_pct").alias("moisture_compliance_pct"),
                    batch_status(z("moisture_compliance_pct")).alias("status"))


def graph_nodes(registry: DataFrame, gold_eq: DataFrame, gold_batch: DataFrame,
                n: int | None = C.GRAPH_BATCHES, partitioned: bool = False) -> DataFrame:
    """K8 + D1: batch nodes then equipment nodes, concatenated without dedup."""
    nodes = batch_nodes(gold_batch, n).unionByName(equipment_nodes(registry, gold_eq, partitioned),
                                                   allowMissingColumns=True)
    return nodes.select(*NODE_COLUMNS)


def node_ids(registry: DataFrame, gold_batch: DataFrame, n: int | None = C.GRAPH_BATCHES) -> DataFrame:
    """The ids of :func:`graph_nodes` alone: machines by the registry and the listed batches, without the nodes' metrics."""
    b = gold_batch if n is None else newest_batches(gold_batch.select("batch_id", "plant_id", "batch_first_seen"), n)
    return registry.select(F.col("equipment_id").alias("id")).union(b.select("batch_id"))


def graph_edges(silver: DataFrame, as_of=None, hours: int = C.GRAPH_EDGE_HOURS,
                n: int | None = C.GRAPH_EDGE_LIMIT) -> DataFrame:
    """A5 + K9 + T5: batch -> machine event counts of the last ``hours``, top ``n`` (the page's
    limit) or all with ``n=None``.

    One partial/final aggregate on the four keys over the pruned recent slice of
    silver, then a bounded top-n with a full tie-break.
    """
    s = since(silver.filter(F.col("batch_id").isNotNull() & F.col("equipment_id").isNotNull()),
              "event_ts", as_of, hours=hours, date_col="event_date")
    counts = (s.groupBy("batch_id", "equipment_id", "equipment_name", "equipment_type")
              .agg(F.count(F.lit(1)).alias("event_count")))
    top = counts if n is None else counts.orderBy(
        F.col("event_count").desc(), "batch_id", "equipment_id", "equipment_name", "equipment_type").limit(n)
    return top.select(F.concat_ws("->", "batch_id", "equipment_id").alias("id"),
                      F.col("batch_id").alias("source"), F.col("equipment_id").alias("target"),
                      F.lit("processed_by").alias("label"), "event_count", "equipment_name", "equipment_type")


def _endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with flags for listed endpoints: two left joins to the *distinct* node ids (no
    fan-out), so the edge list is computed once.  Only the ids of ``nodes`` are used (:func:`node_ids`)."""
    ids = nodes.select(F.col("id").alias("_nid")).distinct()
    src = ids.select(F.col("_nid").alias("_sid"), F.lit(True).alias("source_known"))
    tgt = ids.select(F.col("_nid").alias("_tid"), F.lit(True).alias("target_known"))
    e = (edges.join(src, edges["source"] == src["_sid"], "left")
         .join(tgt, F.col("target") == tgt["_tid"], "left"))
    return e.select(*edges.columns, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("source_known", "target_known")])


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two endpoints are listed nodes."""
    return _endpoints(edges, nodes).filter("source_known AND target_known").drop("source_known", "target_known")


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """J5 (complement): edges with an endpoint that is not among the nodes, flagged."""
    return _endpoints(edges, nodes).filter("NOT source_known OR NOT target_known")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A10: node, edge, batch-node and equipment-node counts in one row."""
    u = nodes.select(F.col("type"), F.lit(False).alias("_edge")).unionByName(
        edges.select(F.lit(None).cast("string").alias("type"), F.lit(True).alias("_edge")))
    return u.agg(F.count_if(~F.col("_edge")).cast("long").alias("nodes"),
                 F.count_if(F.col("_edge")).cast("long").alias("edges"),
                 F.count_if(F.col("type") == "batch").cast("long").alias("batches"),
                 F.count_if(F.col("type") == "equipment").cast("long").alias("equipment"))


def alarm_impact(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Batches processed by machines currently in alarm, with their fat and protein.

    alarm equipment nodes |x| edges (target) |x| batch nodes (source); equi-joins only.
    A batch listed in two plants yields one row per plant.  Pass all nodes and edges
    (``n=None``): the page's limits would hide affected batches.
    """
    eq = nodes.filter((F.col("type") == "equipment") & (F.col("status") == "alarm")).select(
        F.col("id").alias("equipment_id"), F.col("label").alias("equipment_name"),
        F.col("alarm_count"), F.col("plant_id").alias("equipment_plant_id"))
    bt = nodes.filter(F.col("type") == "batch").select(
        F.col("id").alias("batch_id"), F.col("plant_id").alias("batch_plant_id"), "avg_fat_pct",
        "avg_protein_pct", "moisture_compliance_pct")
    e = edges.select(F.col("source").alias("batch_id"), F.col("target").alias("equipment_id"), "event_count")
    return (e.join(eq, "equipment_id").join(bt, "batch_id")
            .select("equipment_id", "equipment_name", "alarm_count", "equipment_plant_id", "batch_id",
                    "batch_plant_id", "avg_fat_pct", "avg_protein_pct", "moisture_compliance_pct", "event_count"))
