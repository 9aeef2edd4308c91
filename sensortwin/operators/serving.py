"""Serving queries over the gold and silver tables.

Every function is ``DataFrame(s) -> DataFrame``; clock-relative ones take ``as_of``
(None = now, a datetime, or a Column such as ``latest_ts(silver)``).  Global results
over bounded inputs (a top-k, a per-plant summary) use a window over those few rows
or a union + one global aggregate -- never a cross join and never a collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import since, trunc_like

# ---------------------------------------------------------------------------
# equipment
# ---------------------------------------------------------------------------


def latest_window(gold_eq: DataFrame, partitioned: bool = False) -> DataFrame:
    """Rows of the single newest 5-minute window (global, not per machine).

    ``MAX(window_5min)`` is an uncorrelated scalar subquery: one small aggregate job whose
    value then filters the scan.  ``partitioned=True`` is for a stored gold table
    partitioned by ``event_date``: a 5-minute bucket never crosses midnight, so the newest
    window lies in the newest date, and both the subquery and the filter read that one
    partition.  (On a computed frame the extra level would only add a scan.)
    """
    if partitioned:
        newest_date = gold_eq.select(F.max("event_date")).scalar()
        gold_eq = gold_eq.filter(F.col("event_date") == newest_date)
    newest = gold_eq.select(F.max("window_5min")).scalar()
    return gold_eq.filter(F.col("window_5min") == newest)


def latest_equipment_metrics(gold_eq: DataFrame, partitioned: bool = False) -> DataFrame:
    """All machines in the latest window, API projection, sorted."""
    return (latest_window(gold_eq, partitioned)
            .select("equipment_id", "equipment_name", "equipment_type", "plant_id", "line_id",
                    F.col("window_5min").cast("string").alias("window_5min"),
                    "avg_temperature_c",
                    "max_temperature_c",
                    "total_energy_kwh",
                    "avg_flow_rate_l_min",
                    F.col("alarm_count").cast("int").alias("alarm_count"),
                    F.col("event_count").cast("int").alias("event_count"))
            .orderBy("plant_id", "line_id", "equipment_name", "equipment_id"))


def equipment_history(gold_eq: DataFrame, equipment_id: str | None = None, hours: int = 1,
                      as_of=None) -> DataFrame:
    """K17 (P11, P12): one machine's windows of the last ``hours``, oldest first.

    ``equipment_id=None`` returns the history of every machine (keyed by id).
    """
    g = gold_eq
    if equipment_id is not None:
        g = g.filter(F.col("equipment_id") == F.lit(equipment_id))
    g = since(g, "window_5min", as_of, hours=hours, date_col="event_date")
    return (g.select("equipment_id",
                     F.col("window_5min").cast("string").alias("window_5min"),
                     "avg_temperature_c",
                     "total_energy_kwh",
                     F.col("alarm_count").cast("int").alias("alarm_count"),
                     "avg_flow_rate_l_min")
            .orderBy("equipment_id", "window_5min"))


def equipment_reference(registry: DataFrame) -> DataFrame:
    """K19 (P14): registry listing with the API's names, sorted by plant, line, name."""
    return (registry.select("equipment_id", F.col("name").alias("equipment_name"),
                            F.col("type").alias("equipment_type"), "plant_id", "line_id",
                            "capacity_kg_h", F.col("commissioned_year").alias("install_year"))
            .orderBy("plant_id", "line_id", "equipment_name", "equipment_id"))


def machine_status(alarm_count: Column, avg_temperature: Column,
                   warm_c: float = C.WARM_TEMPERATURE_C) -> Column:
    """K3: alarm if any alarm, warning if hotter than 85 C, else ok (NULL counts as 0)."""
    return (F.when(F.coalesce(alarm_count, F.lit(0)) > 0, F.lit("alarm"))
            .when(F.coalesce(avg_temperature, F.lit(0.0)) > warm_c, F.lit("warning"))
            .otherwise(F.lit("ok")))


def equipment_status(registry: DataFrame, gold_eq: DataFrame, partitioned: bool = False) -> DataFrame:
    """J1 + K3: every registered machine with its latest-window metrics or 0 defaults.

    A left outer equi-join of the registry to the latest window.  No broadcast hint:
    AQE turns it into a broadcast join when the *measured* latest-window side is
    small and keeps a sort-merge join otherwise.
    """
    m = latest_window(gold_eq, partitioned).select("equipment_id", "avg_temperature_c", "total_energy_kwh",
                                                  "alarm_count")
    j = registry.join(m, "equipment_id", "left")
    temp = F.coalesce(F.col("avg_temperature_c").cast("double"), F.lit(0.0))
    energy = F.coalesce(F.col("total_energy_kwh").cast("double"), F.lit(0.0))
    alarms = F.coalesce(F.col("alarm_count").cast("int"), F.lit(0))
    return (j.select("equipment_id", F.col("name").alias("equipment_name"),
                     F.col("type").alias("equipment_type"), "plant_id", "line_id",
                     temp.alias("avg_temperature_c"), energy.alias("total_energy_kwh"),
                     alarms.alias("alarm_count"), machine_status(alarms, temp).alias("status"))
            .orderBy("plant_id", "equipment_type", "equipment_id"))


def equipment_grid(gold_eq: DataFrame, full_scale: float = C.FLOW_FULL_SCALE, partitioned: bool = False) -> DataFrame:
    """K15 + K3: latest-window cards with status and flow utilisation (capped at 100 %)."""
    m = latest_equipment_metrics(gold_eq, partitioned)
    util = F.least(F.lit(100.0), F.coalesce(F.col("avg_flow_rate_l_min"), F.lit(0.0)) / F.lit(full_scale) * 100.0)
    return m.select("*", machine_status(F.col("alarm_count"), F.col("avg_temperature_c")).alias("status"),
                    util.alias("flow_utilisation_pct"))


# ---------------------------------------------------------------------------
# batches (T1, T2, K5, K16)
# ---------------------------------------------------------------------------


def newest_batches(gold_batch: DataFrame, n: int = C.NEWEST_BATCHES) -> DataFrame:
    """The ``n`` most recently started (batch, plant) rows, full tie-break.

    Planned as TakeOrderedAndProject: a per-partition top-n, then n rows per partition
    merged -- no full sort, no shuffle of the table.
    """
    return gold_batch.orderBy(F.col("batch_first_seen").desc(), "batch_id", "plant_id").limit(n)


def batch_yield_report(gold_batch: DataFrame, n: int = C.NEWEST_BATCHES) -> DataFrame:
    """The batch-quality listing: 20 newest, API projection."""
    return newest_batches(gold_batch, n).select(
        "batch_id", "plant_id", "line_ids",
        F.col("batch_first_seen").cast("string").alias("batch_first_seen"),
        F.col("batch_last_seen").cast("string").alias("batch_last_seen"),
        "avg_moisture_pct", "moisture_compliance_pct", "avg_viscosity_cp", "avg_protein_pct",
        "avg_fat_pct", "ftr_rate_pct", "total_energy_kwh",
        F.col("total_events").cast("int").alias("event_count"))


def simulatable_batches(gold_batch: DataFrame, n: int = C.GRAPH_BATCHES) -> DataFrame:
    """The 15 newest batches offered to the simulator."""
    return newest_batches(gold_batch, n).select("batch_id", "plant_id", "avg_fat_pct", "avg_protein_pct",
                                                "ftr_rate_pct")


def batch_badges(gold_batch: DataFrame, n: int = C.NEWEST_BATCHES) -> DataFrame:
    """K5: compliance and FTR badges of the newest batches (NULL counts as 0)."""
    c = F.coalesce(F.col("moisture_compliance_pct"), F.lit(0.0))
    f = F.coalesce(F.col("ftr_rate_pct"), F.lit(0.0))
    return newest_batches(gold_batch, n).select(
        "batch_id", "plant_id", "moisture_compliance_pct", "ftr_rate_pct",
        F.when(c >= C.BADGE_COMPLIANCE_OK, "ok").when(c >= C.BADGE_COMPLIANCE_WARNING, "warning")
         .otherwise("alarm").alias("compliance_badge"),
        F.when(f >= C.BADGE_FTR_OK, "ok").otherwise("warning").alias("ftr_badge"))


# ---------------------------------------------------------------------------
# dashboard
# ---------------------------------------------------------------------------


def dashboard_kpis(gold_eq: DataFrame, gold_batch: DataFrame, n: int = C.NEWEST_BATCHES,
                   partitioned: bool = False) -> DataFrame:
    """A6 + K6: the five dashboard KPIs and their trend flags, one row.

    Latest-window machines and the newest batches are unioned and reduced by a single
    global aggregate; NULL metrics count as 0 and an empty side yields 0.
    """
    eq = latest_window(gold_eq, partitioned).select(
        F.lit(True).alias("_eq"), F.col("alarm_count").cast("long").alias("_alarms"),
        F.col("avg_temperature_c").alias("_temp"), F.col("total_energy_kwh").alias("_energy"),
        F.lit(None).cast("double").alias("_ftr"), F.lit(None).cast("double").alias("_compliance"))
    bt = newest_batches(gold_batch, n).select(
        F.lit(False).alias("_eq"), F.lit(None).cast("long").alias("_alarms"),
        F.lit(None).cast("double").alias("_temp"), F.lit(None).cast("double").alias("_energy"),
        F.col("ftr_rate_pct").alias("_ftr"), F.col("moisture_compliance_pct").alias("_compliance"))
    u = eq.unionByName(bt)
    on_eq, on_bt = F.col("_eq"), ~F.col("_eq")
    agg = u.agg(
        F.coalesce(F.sum(F.when(on_eq, F.coalesce("_alarms", F.lit(0)))), F.lit(0)).cast("long").alias("total_alarms"),
        F.coalesce(F.avg(F.when(on_eq, F.coalesce("_temp", F.lit(0.0)))), F.lit(0.0)).alias("avg_temperature_c"),
        F.coalesce(F.sum(F.when(on_eq, F.coalesce("_energy", F.lit(0.0)))), F.lit(0.0)).alias("total_energy_kwh"),
        F.coalesce(F.avg(F.when(on_bt, F.coalesce("_ftr", F.lit(0.0)))), F.lit(0.0)).alias("avg_ftr_rate_pct"),
        F.coalesce(F.avg(F.when(on_bt, F.coalesce("_compliance", F.lit(0.0)))), F.lit(0.0))
         .alias("avg_moisture_compliance_pct"))
    return agg.select(
        "*",
        F.when(F.col("total_alarms") > 0, F.lit("down")).alias("alarms_trend"),
        F.when(F.col("avg_ftr_rate_pct") >= C.KPI_FTR_UP, "up").otherwise("down").alias("ftr_trend"),
        F.when(F.col("avg_moisture_compliance_pct") >= C.KPI_COMPLIANCE_UP, "up").otherwise("down")
         .alias("compliance_trend"))


# ---------------------------------------------------------------------------
# sustainability
# ---------------------------------------------------------------------------


def sustainability_window(gold_sus: DataFrame, as_of=None, hours: int = 720) -> DataFrame:
    """P12 + P13: hourly rows since ``as_of - hours``; no filter when ``hours <= 0``."""
    if hours and hours > 0:
        return since(gold_sus, "hour_bucket", as_of, hours=hours, date_col="event_date")
    return gold_sus


def sustainability(gold_sus: DataFrame, as_of=None, hours: int = 720) -> DataFrame:
    """The hourly sustainability listing, oldest first."""
    return (sustainability_window(gold_sus, as_of, hours)
            .select("plant_id", "line_id", F.col("hour_bucket").cast("string").alias("hour_bucket"),
                    "total_energy_kwh",
                    "cip_water_liters",
                    "total_water_liters",
                    "estimated_co2_kg",
                    F.col("water_alarm_count").cast("int").alias("water_alarm_count"),
                    F.col("total_events").cast("int").alias("event_count"))
            .orderBy("hour_bucket", "plant_id", "line_id"))


def plant_summary(gold_sus: DataFrame) -> DataFrame:
    """A4: totals per plant (sums the already rounded hourly CO2, as the application does)."""
    return (gold_sus.groupBy("plant_id")
            .agg(F.sum("total_energy_kwh").alias("total_energy_kwh"),
                 F.sum("total_water_liters").alias("total_water_liters"),
                 F.sum("cip_water_liters").alias("cip_water_liters"),
                 F.sum("estimated_co2_kg").alias("estimated_co2_kg"),
                 F.sum("water_alarm_count").cast("int").alias("water_alarm_count"))
            .orderBy("plant_id"))


def hourly_trend(gold_sus: DataFrame, as_of=None, hours: int = 720) -> DataFrame:
    """CO2 / energy / water / CIP per hour across plants and lines, ordered."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (sustainability_window(gold_sus, as_of, hours)
            .groupBy("hour_bucket")
            .agg(F.sum(z("estimated_co2_kg")).alias("co2_kg"), F.sum(z("total_energy_kwh")).alias("energy_kwh"),
                 F.sum(z("total_water_liters")).alias("water_liters"),
                 F.sum(z("cip_water_liters")).alias("cip_water_liters"))
            .select(F.date_format("hour_bucket", "HH:mm").alias("label"), "*")
            .orderBy("hour_bucket"))


def sustainability_kpis(summary: DataFrame, target: float = C.ENERGY_INTENSITY_TARGET) -> DataFrame:
    """Totals over plants and energy intensity in kWh per kL (NULL without water)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    t = summary.agg(F.coalesce(F.sum(z("estimated_co2_kg")), F.lit(0.0)).alias("total_co2_kg"),
                    F.coalesce(F.sum(z("total_energy_kwh")), F.lit(0.0)).alias("total_energy_kwh"),
                    F.coalesce(F.sum(z("total_water_liters")), F.lit(0.0)).alias("total_water_liters"),
                    F.coalesce(F.sum(z("cip_water_liters")), F.lit(0.0)).alias("total_cip_water_liters"))
    intensity = F.when(F.col("total_water_liters") != 0,
                       F.col("total_energy_kwh") / (F.col("total_water_liters") / 1000.0))
    meets = F.when(F.col("total_water_liters") > 0, intensity <= target).otherwise(F.lit(False))
    return t.select("*", intensity.alias("energy_intensity_kwh_per_kl"), meets.alias("meets_target"))


def plant_energy_share(summary: DataFrame) -> DataFrame:
    """Plant energy as % of the largest plant (denominator at least 1), capped at 100.

    The maximum is an uncorrelated scalar subquery (partial max per partition, one value
    back), so no rows are gathered into one task whatever the size of ``summary``.
    """
    e = F.coalesce(F.col("total_energy_kwh"), F.lit(0.0))
    top = F.greatest(summary.select(F.max(e)).scalar(), F.lit(1.0))
    return summary.select("plant_id", "total_energy_kwh",
                          F.least(F.lit(100.0), e / top * 100.0).alias("energy_share_pct"))


def carbon_traceback(gold_batch: DataFrame, n: int = C.NEWEST_BATCHES,
                     factor: float = C.CO2_KG_PER_KWH) -> DataFrame:
    """W1 + W2: CO2 of the newest batches against their average, ranked, with severity.

    The average and the ranking are windows over the ``n`` selected rows only.
    """
    top = newest_batches(gold_batch, n).select(
        "batch_id", "plant_id", "line_ids", "avg_protein_pct", "avg_fat_pct", "avg_viscosity_cp",
        "total_energy_kwh", "ftr_rate_pct", "batch_first_seen", "avg_moisture_pct",
        "moisture_compliance_pct", F.col("total_events").cast("int").alias("event_count"))
    e = F.coalesce(F.col("total_energy_kwh"), F.lit(0.0))
    avg_e = F.avg(e).over(Window.partitionBy())
    vs = F.when(avg_e != 0, (e - avg_e) / avg_e * 100.0).otherwise(F.lit(0.0))
    out = top.select("*", F.round(e * F.lit(factor), 2).alias("estimated_co2_kg"),
                     F.round(vs, 1).alias("co2_vs_avg_pct"))
    rank_order = Window.orderBy(F.coalesce(F.col("estimated_co2_kg"), F.lit(0.0)).desc(),
                                F.col("batch_first_seen").desc(), "batch_id", "plant_id")
    vs_c = F.coalesce(F.col("co2_vs_avg_pct"), F.lit(0.0))
    return (out.select("*", F.row_number().over(rank_order).alias("co2_rank"),
                       F.when(vs_c > C.CARBON_ALARM_PCT, "alarm").when(vs_c > 0, "warning")
                        .otherwise("ok").alias("severity"))
            .withColumn("batch_first_seen", F.col("batch_first_seen").cast("string"))
            .orderBy("co2_rank"))


def carbon_insight(traceback: DataFrame) -> DataFrame:
    """Worst vs best batch of the traceback and the % gap (0 when best is 0/NULL)."""
    s = F.struct("batch_id", "plant_id", "estimated_co2_kg", "avg_fat_pct", "avg_viscosity_cp")
    t = traceback.agg(F.max_by(s, "co2_rank").alias("best"), F.min_by(s, "co2_rank").alias("worst"))
    w, b = F.coalesce(F.col("worst.estimated_co2_kg"), F.lit(0.0)), F.col("best.estimated_co2_kg")
    gap = F.when(F.coalesce(b, F.lit(0.0)) != 0, (w - F.coalesce(b, F.lit(0.0))) / b * 100.0).otherwise(F.lit(0.0))
    return t.filter(F.col("worst").isNotNull()).select(
        F.col("worst.batch_id").alias("worst_batch_id"), F.col("worst.plant_id").alias("worst_plant_id"),
        F.col("worst.estimated_co2_kg").alias("worst_co2_kg"), F.col("worst.avg_fat_pct").alias("worst_fat_pct"),
        F.col("worst.avg_viscosity_cp").alias("worst_viscosity_cp"),
        F.col("best.batch_id").alias("best_batch_id"), F.col("best.plant_id").alias("best_plant_id"),
        F.col("best.estimated_co2_kg").alias("best_co2_kg"), gap.alias("gap_pct"))


# ---------------------------------------------------------------------------
# live feed
# ---------------------------------------------------------------------------

LIVE_COLUMNS = ("event_ts", "event_type", "equipment_id", "equipment_name", "equipment_type", "plant_id",
                "line_id", "batch_id", "temperature_c", "moisture_pct", "energy_kwh", "flow_rate_lph",
                "viscosity_cp", "pressure_kpa", "alarm_code", "moisture_quality")


def live_projection(silver: DataFrame) -> DataFrame:
    """The 16-column live-event view (flow is only renamed, not converted)."""
    return silver.select(
        F.col("event_ts").cast("string").alias("event_ts"), "event_type", "equipment_id", "equipment_name",
        "equipment_type", "plant_id", "line_id", "batch_id", "temperature_c", "moisture_pct", "energy_kwh",
        F.col("flow_rate_l_min").alias("flow_rate_lph"), "viscosity_cp", "pressure_kpa", "alarm_code",
        "moisture_quality")


def _newest_events(silver: DataFrame, as_of, seconds: int, limit: int) -> DataFrame:
    recent = since(silver, "event_ts", as_of, seconds=seconds, date_col="event_date")
    return recent.orderBy(F.col("event_ts").desc(), F.col("event_id").desc()).limit(limit)


def recent_events(silver: DataFrame, as_of=None, seconds: int = C.POLL_SECONDS,
                  limit: int = C.POLL_LIMIT) -> DataFrame:
    """Newest events of the last ``seconds``, newest first, at most ``limit``."""
    top = _newest_events(silver, as_of, seconds, limit)
    return live_projection(top).select(*LIVE_COLUMNS, F.col("event_ts").alias("_o")) \
        .orderBy(F.col("_o").desc()).drop("_o")


def event_history(silver: DataFrame, as_of=None, seconds: int = C.HISTORY_SECONDS,
                  limit: int = C.HISTORY_LIMIT) -> DataFrame:
    """T4: the same top-k over 5 minutes, then re-ordered oldest first for charting."""
    top = _newest_events(silver, as_of, seconds, limit)
    return live_projection(top.orderBy("event_ts", "event_id"))


def event_status(alarm_code: str | Column = "alarm_code",
                 moisture_quality: str | Column = "moisture_quality") -> Column:
    """K7: the alarm code if any; else OOB when moisture is classified and not in spec; else OK."""
    alarm_code = F.col(alarm_code) if isinstance(alarm_code, str) else alarm_code
    moisture_quality = F.col(moisture_quality) if isinstance(moisture_quality, str) else moisture_quality
    return (F.when(alarm_code.isNotNull(), alarm_code)
            .when(moisture_quality.isNotNull() & (moisture_quality != F.lit("IN_SPEC")), F.lit("OOB"))
            .otherwise(F.lit("OK")))


def event_feed(silver: DataFrame, as_of=None, rows: int = C.FEED_ROWS,
               seconds: int = C.HISTORY_SECONDS) -> DataFrame:
    """T8 + K7: the newest ``rows`` events of the feed buffer with their status badge."""
    top = _newest_events(silver, as_of, seconds, rows)
    return live_projection(top).select(
        F.substring("event_ts", 12, 8).alias("time"), "event_ts", "equipment_id", "equipment_name",
        "temperature_c", "energy_kwh", "moisture_pct", event_status().alias("status"))


def live_series(events: DataFrame) -> DataFrame:
    """Per-second averages over non-NULL values, 2 decimals."""
    sec = trunc_like(events, "second")
    return (events.groupBy(sec.alias("second"))
            .agg(F.round(F.avg("temperature_c"), 2).alias("temp"),
                 F.round(F.avg("energy_kwh"), 2).alias("energy"),
                 F.round(F.avg("moisture_pct"), 2).alias("moisture"),
                 F.round(F.avg("flow_rate_l_min"), 2).alias("flow"))
            .select(F.date_format("second", "HH:mm:ss").alias("label"), "*")
            .orderBy("second"))


DEDUP_KEYS = ("event_ts", "equipment_id", "event_type")


def dedup_events(events: DataFrame, keys=DEDUP_KEYS, order_col: str = "event_id") -> DataFrame:
    """D3 (batch): one event per key, deterministically the smallest ``order_col``.

    A grouped ``min_by`` aggregate (sort-based: its struct-of-strings buffer is not
    fixed-width, so it spills rather than failing); duplicates still collapse map-side
    before the shuffle, so a hot key does not become a hot task.
    """
    rest = [c for c in events.columns if c not in keys]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.col(order_col)).alias("_row")
    out = events.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return out.select(*events.columns)  # the input's column order


def event_rate(events: DataFrame, tick: str = "5 seconds", tick_seconds: int = C.RATE_TICK_SECONDS,
               keys=DEDUP_KEYS) -> DataFrame:
    """New (deduplicated) events per tick and per second."""
    d = events.select(*keys).dropDuplicates(list(keys))
    return (d.groupBy(F.window("event_ts", tick).start.alias("tick_start"))
            .agg(F.count(F.lit(1)).alias("new_events"))
            .select("tick_start", "new_events",
                    F.round(F.col("new_events") / float(tick_seconds)).cast("long").alias("events_per_sec"))
            .orderBy("tick_start"))


def published_equipment_windows(gold_eq: DataFrame, n: int = 20) -> DataFrame:
    """Newest equipment windows."""
    return (gold_eq.orderBy(F.col("window_5min").desc(), "equipment_id", "event_date", "equipment_name",
                            "equipment_type", "line_id", "plant_id").limit(n)
            .select("equipment_name", "equipment_type", "plant_id", "window_5min", "avg_temperature_c",
                    "total_energy_kwh", "alarm_count"))


def published_batches(gold_batch: DataFrame) -> DataFrame:
    """Batch quality, newest first."""
    return (gold_batch.select("batch_id", "plant_id", "avg_moisture_pct", "moisture_compliance_pct",
                              "avg_viscosity_cp", "ftr_rate_pct", "total_energy_kwh", "batch_first_seen")
            .orderBy(F.col("batch_first_seen").desc(), "batch_id", "plant_id").drop("batch_first_seen"))


def published_sustainability(gold_sus: DataFrame) -> DataFrame:
    """Hourly sustainability rows, newest first."""
    return (gold_sus.select("plant_id", "line_id", "hour_bucket", "total_energy_kwh", "cip_water_liters",
                            "total_water_liters", "estimated_co2_kg", "water_alarm_count")
            .orderBy(F.col("hour_bucket").desc(), "plant_id", "line_id"))


def published_events(silver: DataFrame, n: int = 50) -> DataFrame:
    """The 50 newest raw events."""
    return (silver.orderBy(F.col("event_ts").desc(), F.col("event_id").desc()).limit(n)
            .select("event_ts", "event_type", "equipment_name", "plant_id", "temperature_c", "moisture_pct",
                    "energy_kwh", "alarm_code"))

