"""Aggregations (A1-A11), all with map-side partial aggregation, so a hot key
costs one partial row per task before the shuffle.  Counts are hash aggregates;
those with sets of services are object aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, RANK


def severity_distribution(entries: DataFrame, keys: tuple[str, ...] = ("session_name",)) -> DataFrame:
    """A2: entries per severity (long form) for each key."""
    return (entries.groupBy(*keys, "severity")
            .agg(F.count(F.lit(1)).alias("entry_count"), F.min("sev_rank").alias("sev_rank")))


def severity_map(entries: DataFrame) -> DataFrame:
    """A2 as one row per session with a ``severity -> count`` map."""
    d = severity_distribution(entries)
    return d.groupBy("session_name").agg(
        F.map_from_entries(F.collect_list(F.struct("severity", "entry_count"))).alias("by_severity"))


def severity_columns(entries: DataFrame, keys: tuple[str, ...] = ("session_name",)) -> DataFrame:
    """A2 as one column per level (``n_trace`` .. ``n_unknown``)."""
    return entries.groupBy(*keys).agg(*[
        F.count_if(F.col("severity") == lv).alias(f"n_{lv.lower()}") for lv in LEVELS])


def count_by_severity(durable: DataFrame, since: dt.datetime) -> DataFrame:
    """A1: durable rows with ``timestamp >= since`` per session and severity."""
    return (durable.where(F.col("timestamp") >= F.lit(since))
            .groupBy("session_name", "severity").agg(F.count(F.lit(1)).alias("entry_count")))


def services_by_frequency(entries: DataFrame) -> DataFrame:
    """A3: entries per service, ranked by count desc then name (per session)."""
    counts = (entries.where(F.col("service").isNotNull())
              .groupBy("session_name", "service").agg(F.count(F.lit(1)).alias("entry_count")))
    w = Window.partitionBy("session_name").orderBy(F.desc("entry_count"), "service")
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


def service_set(entries: DataFrame) -> DataFrame:
    """A3 sorted distinct form (one row per session)."""
    return (entries.where(F.col("service").isNotNull()).groupBy("session_name")
            .agg(F.array_sort(F.collect_set("service")).alias("services")))


def error_counts(entries: DataFrame, keys: tuple[str, ...] = ("session_name",)) -> DataFrame:
    """A5: ERROR and FATAL counts."""
    return entries.groupBy(*keys).agg(
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "FATAL").alias("fatal_count"))


def session_stats(entries: DataFrame, signatures: DataFrame | None = None,
                  incidents: DataFrame | None = None, alerts: DataFrame | None = None) -> DataFrame:
    """A4: per session entries, error+fatal, patterns, incidents and alerts.

    Each table is aggregated to one row per session first; the joins are
    then between session-sized tables.
    """
    base = entries.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(F.col("severity").isin("ERROR", "FATAL")).alias("errors"))
    for name, df in (("patterns", signatures), ("incidents", incidents), ("alerts", alerts)):
        if df is None:
            base = base.withColumn(name, F.lit(0).cast("long"))
            continue
        c = df.groupBy("session_name").agg(F.count(F.lit(1)).alias(name))
        base = (base.join(c, "session_name", "left")
                .withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long"))))
    return base


def buffer_stats(entries: DataFrame, capacity: int) -> DataFrame:
    """Per session panes, retained entries (min(count, capacity) per pane),
    total capacity and utilisation percent (0 when capacity is 0)."""
    per_pane = entries.groupBy("session_name", "pane_id").agg(F.count(F.lit(1)).alias("n"))
    kept = F.least(F.col("n"), F.lit(capacity))
    out = per_pane.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("panes"), F.sum(kept).alias("entries"))
    cap = F.col("panes") * F.lit(capacity)
    return (out.withColumn("capacity", cap.cast("long"))
            .withColumn("utilization_pct",
                        F.when(F.col("capacity") > 0, F.col("entries") * 100.0 / F.col("capacity"))
                        .otherwise(F.lit(0.0))))


def pattern_totals(clusters: DataFrame, patterns: DataFrame) -> DataFrame:
    """Distinct clusters and active patterns per session."""
    c = clusters.groupBy("session_name").agg(F.countDistinct("leader").alias("total_clusters"))
    p = patterns.groupBy("session_name").agg(F.count(F.lit(1)).alias("active_patterns"))
    return c.join(p, "session_name", "full")


def unpatterned_spike(entries: DataFrame, window: str, min_errors: int = 10) -> DataFrame:
    """A10: tumbling windows with at least ``min_errors`` ERROR/FATAL lines per
    session become incidents; severity is the highest, services the distinct set."""
    errs = entries.where(F.col("severity").isin("ERROR", "FATAL"))
    g = errs.groupBy("session_name", F.window("timestamp", window).alias("w")).agg(
        F.count(F.lit(1)).alias("error_count"), F.max("sev_rank").alias("_r"),
        F.array_sort(F.collect_set("service")).alias("affected_services"))
    lv = F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_r") + 1)
    return (g.where(F.col("error_count") >= min_errors)
            .select("session_name", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "error_count", lv.alias("severity"),
                    "affected_services",
                    F.concat(F.lit("Unpatterned error spike: "), F.col("error_count").cast("string"),
                             F.lit(" errors")).alias("title")))


def entry_counters(entries: DataFrame, observation) -> DataFrame:
    """Counters collected on the fly with ``observe`` (no extra pass);
    ``observation`` is a ``pyspark.sql.Observation`` (or a name, read by a
    streaming query listener)."""
    return entries.observe(
        observation, F.count(F.lit(1)).alias("parsed"),
        F.count_if(F.col("sev_rank") >= RANK["ERROR"]).alias("errors"),
        F.count_if(F.col("ts_source") == "received").alias("unparsed_time"))


def pipeline_counters(entries: DataFrame, clusters: DataFrame, patterns: DataFrame, incidents: DataFrame,
                      alerts: DataFrame) -> DataFrame:
    """A11 per session: lines captured, parsed (a time, level or service was found), deduplicated (joined
    the cluster of an earlier line), patterns, incidents and alerts, and lines a second of its span."""
    found = (F.col("ts_source") != "received") | (F.col("severity") != "UNKNOWN") | F.col("service").isNotNull()
    span = F.max("received_at").cast("double") - F.min("received_at").cast("double")
    out = entries.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("captured"), F.count_if(found).alias("parsed"), span.alias("seconds"))
    out = out.join(clusters.groupBy("session_name").agg(F.sum(F.col("members") - 1).alias("deduplicated")), "session_name", "left")
    for name, table in (("patterns", patterns), ("incidents", incidents), ("alerts", alerts)):
        out = out.join(table.groupBy("session_name").agg(F.count(F.lit(1)).alias(name)), "session_name", "left")
    rate = F.when(F.col("seconds") > 0, F.col("captured") / F.col("seconds"))
    return out.fillna(0, subset=["deduplicated", "patterns", "incidents", "alerts"]).withColumn("per_second", rate)
