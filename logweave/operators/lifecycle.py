"""Buffers, retention and session liveness.

Per-pane order is the order of arrival; ``sequence`` may have gaps or repeat.
"Last n" is a group limit, places and gaps are found by chunks, so no pane is
walked by one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import arrival_positions, join_keys


def _newest(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of each (session, pane) that arrived last.  A row number
    up to ``n`` is a group limit: each task ships ``n`` rows a pane."""
    last = Window.partitionBy("session_name", "pane_id").orderBy(F.desc("received_at"), F.desc("sequence"))
    return df.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= n).drop("_nth")


def ring_last_n(entries: DataFrame, capacity: int) -> DataFrame:
    """The newest ``capacity`` rows of each pane (ring-buffer contents)."""
    return _newest(entries, capacity)


def snapshot_scan(lines: DataFrame, n: int = 1000, drop_blank: bool = True) -> DataFrame:
    """S3: the last ``n`` lines of each pane, trimmed, blank lines dropped
    (the ask/stats/search form)."""
    out = _newest(lines, n).withColumn("raw", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    return out.where(F.col("raw") != "") if drop_blank else out


def retention_trim(entries: DataFrame, as_of: dt.datetime, retention_seconds: int,
                   exact: bool = False) -> DataFrame:
    """Drop old rows.

    ``exact`` keeps rows with ``timestamp >= as_of - retention``.  The default
    (buffer form) drops from the front of each (session, pane), in the order of arrival, only
    while rows are old: everything from the first new-enough row on is kept.
    """
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {int(retention_seconds)} SECONDS")
    if exact:
        return entries.where(F.col("timestamp") >= cutoff)
    placed = arrival_positions(entries, "raw_content")
    first_new = (placed.where(F.col("timestamp") >= cutoff)
                 .groupBy("session_name", "pane_id").agg(F.min("_pos").alias("_keep_from")))
    return (join_keys(placed, first_new, ["session_name", "pane_id"])
            .where(F.col("_pos") >= F.col("_keep_from")).drop("_pos", "_keep_from"))


def pane_gaps(entries: DataFrame) -> DataFrame:
    """Each line's arrival with the gap to the line before it in its (session, pane).

    ``lag`` within (session, pane, hour); the first line of an hour takes the last
    arrival of the pane's hour with lines before it, from a small table of hours."""
    pane = ["session_name", "pane_id"]
    t = entries.select(*pane, "received_at", F.date_trunc("hour", F.col("received_at")).alias("_hour"))
    t = t.withColumn("_prev", F.lag("received_at").over(Window.partitionBy(*pane, "_hour").orderBy("received_at")))
    hours = t.groupBy(*pane, "_hour").agg(F.max("received_at").alias("_last"))
    carry = hours.select(*pane, "_hour", F.lag("_last").over(Window.partitionBy(*pane).orderBy("_hour")).alias("_carry"))
    prev = F.coalesce("_prev", "_carry")
    return (join_keys(t, carry, [*pane, "_hour"])
            .withColumn("gap_seconds", F.col("received_at").cast("double") - prev.cast("double"))
            .select(*pane, "received_at", "gap_seconds"))


def session_liveness(entries: DataFrame, as_of: dt.datetime, stale_after_s: int,
                     disconnect_after_s: int) -> DataFrame:
    """L4 re-aimed on event time, per pane.

    A silence longer than ``stale_after_s`` is a Stale episode, longer than
    ``disconnect_after_s`` a Disconnected one; the status at ``as_of`` comes
    from the time since the last line.
    """
    g = pane_gaps(entries)
    per = g.groupBy("session_name", "pane_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.max("received_at").alias("last_seen"),
        F.count_if(F.col("gap_seconds") > stale_after_s).alias("stale_gaps"),
        F.count_if(F.col("gap_seconds") > disconnect_after_s).alias("disconnect_gaps"))
    idle = F.lit(as_of).cast("double") - F.col("last_seen").cast("double")
    status = (F.when(idle <= stale_after_s, F.lit("Active"))
              .when(idle <= disconnect_after_s, F.lit("Stale")).otherwise(F.lit("Disconnected")))
    return per.withColumn("idle_seconds", idle).withColumn("status", status)


def stale_sessions(entries: DataFrame, as_of: dt.datetime, idle_seconds: int) -> DataFrame:
    """L2: sessions with no line for ``idle_seconds`` at ``as_of`` (flagged)."""
    per = entries.groupBy("session_name").agg(F.max("received_at").alias("last_seen"))
    idle = F.lit(as_of).cast("double") - F.col("last_seen").cast("double")
    return per.withColumn("idle_seconds", idle).withColumn("is_stale", idle > idle_seconds)


def purge_stale(entries: DataFrame, as_of: dt.datetime, idle_seconds: int) -> DataFrame:
    """L2 applied: drop every row of a stale session (anti-join on the small
    per-session table)."""
    stale = stale_sessions(entries, as_of, idle_seconds).where("is_stale").select("session_name")
    return entries.join(stale, "session_name", "left_anti")


def sessions(entries: DataFrame) -> DataFrame:
    """L3: session listing with pane ids."""
    return entries.groupBy("session_name").agg(
        F.array_sort(F.collect_set("pane_id")).alias("pane_ids"),
        F.min("received_at").alias("created_at"), F.max("received_at").alias("last_seen"))
