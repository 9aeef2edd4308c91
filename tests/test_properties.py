"""Properties over the whole sf0.001 fixture and a randomized check of the
silver classes against a plain-Python statement of the rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sensortwin.functions import classify_energy, classify_moisture
from sensortwin.operators import graph
from sensortwin.plans.inputs import Inputs

from twin_rows import SF_SMALL


def _moisture(m):
    if m is None:
        return None
    if 3.0 <= m <= 5.0:
        return "IN_SPEC"
    if 2.5 <= m <= 5.5:
        return "MARGINAL"
    return "OUT_OF_SPEC"


def _energy(e):
    if e is None:
        return None
    if e < 50:
        return "LOW"
    return "MEDIUM" if e <= 200 else "HIGH"


def test_classes_match_rules_on_random_values(spark):
    rng = random.Random(3)
    vals = [None, 2.5, 3.0, 5.0, 5.5, 50.0, 200.0] + [round(rng.uniform(-1, 300), rng.choice([0, 1, 2, 3]))
                                                     for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", classify_moisture("x").alias("m"), classify_energy("x").alias("e")).collect()
    for r in got:
        assert r["m"] == _moisture(r["x"]) and r["e"] == _energy(r["x"]), r


def test_graph_properties(spark):
    t = Inputs(spark, SF_SMALL)
    nodes = graph.graph_nodes(t.registry, t.gold_eq, t.gold_batch)
    edges = graph.graph_edges(t.silver, as_of=t.as_of)
    stats = graph.graph_stats(nodes, edges).first()
    assert stats["nodes"] == stats["batches"] + stats["equipment"]
    assert stats["equipment"] == t.registry.count()      # every registered machine, once
    assert stats["batches"] <= 15 and stats["edges"] <= 100
    statuses = {r["status"] for r in nodes.collect()}
    assert statuses <= {"ok", "warning", "alarm"}
    # edge counts never exceed the events they summarize
    total = edges.agg(F.sum("event_count")).first()[0] or 0
    assert total <= t.silver.count()
    resolved = graph.resolve_edges(edges, nodes).count()
    dangling = graph.dangling_edges(edges, nodes).count()
    assert resolved + dangling == stats["edges"]
