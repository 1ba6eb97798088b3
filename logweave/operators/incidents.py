"""Incidents (I1-I5, J2) from incident-trigger rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .patterns import level_of, order_struct

# --- fixed values -----------------------------------------------------------
TITLE_PREFIX = "Pattern spike: "
TITLE_SIGNATURE_CHARS = 8
SPIKE_THRESHOLD = 20
# ----------------------------------------------------------------------------


def incidents(triggers: DataFrame, key: str = "signature", as_of: dt.datetime | None = None,
              auto_resolve_s: int | None = None, actions: DataFrame | None = None) -> DataFrame:
    """One incident per (session, key).

    The first trigger opens it (title with the window count at that moment,
    entry count 0); each later trigger adds one and can only raise severity.
    I3 lists are filled (services of the triggers, the pattern key).
    I4 (optional): resolved when no trigger for ``auto_resolve_s`` before ``as_of``.
    I2 (optional): ``actions(session_name, signature, action, at)`` with
    action resolve/mitigate; the latest action wins (of one moment the first by name).
    """
    first = F.min_by(F.struct("timestamp", "window_count"), order_struct())
    g = triggers.groupBy("session_name", key).agg(
        first.alias("_f"), F.count(F.lit(1)).alias("_n"), F.max("sev_rank").alias("_r"),
        F.max("timestamp").alias("last_trigger"),
        F.array_sort(F.collect_set("service")).alias("affected_services"))
    out = g.select(
        F.md5(F.concat_ws("|", F.col("session_name"), F.col(key))).alias("id"),
        "session_name",
        F.concat(F.lit(TITLE_PREFIX), F.substring(F.col(key), 1, TITLE_SIGNATURE_CHARS),
                 F.lit(" ("), F.col("_f.window_count").cast("string"), F.lit(" occurrences)")).alias("title"),
        level_of(F.col("_r")).alias("severity"),
        F.lit("Active").alias("status"),
        F.col("_f.timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.array(F.col(key)).alias("pattern_ids"),
        "affected_services",
        (F.col("_n") - 1).alias("entry_count"),
        F.col(key).alias("signature"), "last_trigger")
    if auto_resolve_s is not None and as_of is not None:
        quiet = F.lit(as_of).cast("double") - F.col("last_trigger").cast("double")
        done = quiet > auto_resolve_s
        out = (out.withColumn("status", F.when(done, F.lit("Resolved")).otherwise(F.col("status")))
               .withColumn("resolved_at", F.when(done, F.col("last_trigger")
                                                 + F.expr(f"INTERVAL {int(auto_resolve_s)} SECONDS"))))
    if actions is not None:
        last = (actions.withColumn("_rn", F.row_number().over(
            Window.partitionBy("session_name", "signature").orderBy(F.desc("at"), "action")))
            .where("_rn = 1").select("session_name", "signature", F.col("action").alias("_a"),
                                     F.col("at").alias("_at")))
        out = out.join(last, ["session_name", "signature"], "left")
        out = (out.withColumn("status", F.when(F.col("_a") == "resolve", F.lit("Resolved"))
                              .when(F.col("_a") == "mitigate", F.lit("Mitigating")).otherwise(F.col("status")))
               .withColumn("resolved_at", F.when(F.col("_a") == "resolve", F.col("_at"))
                           .otherwise(F.col("resolved_at")))
               .drop("_a", "_at"))
    return out


def incident_patterns(incidents_df: DataFrame, durable: DataFrame, key: str = "signature") -> DataFrame:
    """Durable (high-severity) rows per incident pattern.

    The durable side is aggregated per (session, key) before the join, so the
    join is between two pattern-sized tables.
    """
    d = durable.groupBy("session_name", key).agg(
        F.count(F.lit(1)).alias("durable_rows"), F.min("timestamp").alias("first_durable"),
        F.max("timestamp").alias("last_durable"))
    return (incidents_df.select(F.col("id").alias("incident_id"), "session_name",
                                F.col("signature").alias(key), "severity", "status")
            .join(d, ["session_name", key], "left")
            .withColumn("durable_rows", F.coalesce(F.col("durable_rows"), F.lit(0))))


def spike_windows(windows: DataFrame, threshold: int = SPIKE_THRESHOLD, key: str = "signature") -> DataFrame:
    """Windows whose count reaches the spike threshold (20 by default)."""
    g = windows.groupBy("session_name", key, "window_start").agg(F.max("window_count").alias("window_count"))
    return g.withColumn("is_spike", F.col("window_count") >= threshold)
