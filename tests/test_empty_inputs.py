"""Every registered query runs (and returns no rows or its fixed number, never an error) on empty tables."""

from __future__ import annotations

from sensortwin.plans.catalog import queries
from sensortwin.session import scratch_path

from twin_rows import SF_SMALL

ROWS = {"bronze_row_count": 1, "dashboard_kpis": 1, "busy_dashboard_kpis": 1, "sustainability_kpis": 1, "graph_stats": 1, "named_table_counts": 5}


def test_all_queries_on_empty_tables(spark):
    empty = scratch_path(spark, "empty-sf")
    for name in ("events", "supplier", "customer"):
        spark.read.parquet(f"{SF_SMALL}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for name, fn in sorted(queries().items()):
        n = fn(spark, empty).count()
        assert n == ROWS.get(name, 0), (name, n)
