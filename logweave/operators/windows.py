"""Event-time window operators.

W9 (sliding count per key) is computed without a window partitioned by the
key alone: rows are bucketed into ``width``-long time buckets and each row's
count is assembled from running counts inside its own bucket and the one
before (see ``sliding_count``).  Every window runs over ``(key, bucket)``, so
even a key holding a third of all rows is spread over as many tasks as it
has buckets.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import RANK
from .fold import anchored_windows

# --- fixed values: service state words (checked in this order) ------------
STATE_RULES = [
    ("Starting", ["starting", "start "]),
    ("Stopping", ["stopping", "stop "]),
    ("Stopped", ["stopped", "shutdown"]),
    ("Running", ["started", "ready"]),
]
UNKNOWN_SERVICE = "unknown"
GLOBAL_RATE_KEY = "_global"
# ----------------------------------------------------------------------------


def service_state(text: Column) -> Column:
    """Lower-cased line -> Starting/Stopping/Stopped/Running or NULL."""
    low = F.lower(text)
    expr = None
    for state, words in STATE_RULES:
        cond = low.contains(words[0])
        for w in words[1:]:
            cond = cond | low.contains(w)
        expr = F.when(cond, F.lit(state)) if expr is None else expr.when(cond, F.lit(state))
    return expr


def sliding_count(df: DataFrame, keys: list[str], ts: str, width_s: int,
                  out: str = "rate") -> DataFrame:
    """Per row: rows of the same key with ``ts - width <= t <= ts`` (equal
    times included): ``count(*) over (partition by keys order by ts range
    between width preceding and current row)``, computed bucket-wise.

    With buckets ``b = floor(t / width)`` the range ``[ts - width, ts]`` covers
    only the row's bucket and the one before.  Every row also leaves, at ``t +
    width``, an event in the next bucket, so that all of a count is in one bucket:
    ``count = (rows of the bucket with t' <= ts)
    + (events of the bucket) - (events of the bucket with t' + width < ts)``.
    One shuffle by ``(key, bucket)`` serves both windows; nothing is joined, so
    equal rows do no harm.
    """
    w_us = int(width_s) * 1_000_000
    payload = [c for c in df.columns if c not in keys]
    row = F.struct(F.col(ts).alias("_t"), F.lit(0).alias("_left"), *[F.col(c).alias(c) for c in payload])
    left = F.struct((F.col(ts) + F.expr(f"INTERVAL {int(width_s)} SECONDS")).alias("_t"), F.lit(1).alias("_left"),
                    *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in payload])
    both = (df.select(*keys, F.explode(F.array(row, left)).alias("_e")).select(*keys, "_e.*")
            .withColumn("_b", F.floor(F.unix_micros(F.col("_t")) / F.lit(w_us))))
    # RANGE frame over (t, left): a row sees rows with t' <= ts and events before ts
    upto = Window.partitionBy(*keys, "_b").orderBy("_t", "_left")
    whole = Window.partitionBy(*keys, "_b")
    rate = F.sum(1 - F.col("_left")).over(upto) - F.sum("_left").over(upto) + F.sum("_left").over(whole)
    return both.withColumn(out, rate.cast("long")).where("_left = 0").drop("_t", "_left", "_b").select(*df.columns, out)


def error_rate(entries: DataFrame, width_s: int, include_unknown: bool = True) -> DataFrame:
    """Error lines in the trailing ``width_s`` per session and service
    (``_global`` for lines without a service; it is its own key, not a total)."""
    cond = F.col("sev_rank") >= RANK["ERROR"]
    if not include_unknown:
        cond = cond & (F.col("severity") != "UNKNOWN")
    errs = (entries.where(cond)
            .select("id", "session_name", "timestamp", "pane_id", "sequence",
                    F.coalesce(F.col("service"), F.lit(GLOBAL_RATE_KEY)).alias("rate_key")))
    return sliding_count(errs, ["session_name", "rate_key"], "timestamp", width_s)


def transitions(entries: DataFrame) -> DataFrame:
    """Lines that announce a service state change (W5), service defaulted.
    A precomputed ``state`` column is used as is."""
    if "state" not in entries.columns:
        entries = entries.withColumn("state", service_state(F.col("raw_content")))
    return (entries.where(F.col("state").isNotNull())
            .withColumn("restart_service", F.coalesce(F.col("service"), F.lit(UNKNOWN_SERVICE))))


def restart_windows(entries: DataFrame, width_s: int) -> DataFrame:
    """Anchored windows over state-change lines per (session, service);
    every transition counts whatever the state."""
    t = transitions(entries).select("session_name", "restart_service", "timestamp", "pane_id",
                                    "sequence", "state", "id")
    return anchored_windows(t, ["session_name", "restart_service"], "timestamp",
                            ["pane_id", "sequence"], width_s)


def restart_loops(entries: DataFrame, width_s: int, min_transitions: int = 2) -> DataFrame:
    """W7 per episode: windows with at least ``min_transitions`` transitions."""
    f = restart_windows(entries, width_s)
    g = f.groupBy("session_name", "restart_service", "window_start").agg(
        F.max("window_count").alias("transitions"), F.max("timestamp").alias("last_transition"),
        F.min(F.when(F.col("window_count") == min_transitions, F.col("timestamp"))).alias("loop_detected_at"))
    return g.where(F.col("transitions") >= min_transitions)


def looping_services(entries: DataFrame, width_s: int, as_of: dt.datetime,
                     min_transitions: int = 2) -> DataFrame:
    """W7 at ``as_of``: the latest window has >= 2 transitions and is younger than the width."""
    f = restart_windows(entries, width_s)
    last = f.groupBy("session_name", "restart_service").agg(
        F.max_by(F.struct("window_start", "window_count"),
                 F.struct("timestamp", "pane_id", "sequence")).alias("w"))
    age = F.lit(as_of).cast("double") - F.col("w.window_start").cast("double")
    return (last.where((F.col("w.window_count") >= min_transitions) & (age < width_s))
            .select("session_name", "restart_service", F.col("w.window_start").alias("window_start"),
                    F.col("w.window_count").alias("transitions")))


def restart_cycles(entries: DataFrame, width_s: int) -> DataFrame:
    """W8 (strict): Starting -> Running -> Stopping -> Starting within ``width_s``
    over consecutive transitions of a (session, service)."""
    t = transitions(entries)
    w = Window.partitionBy("session_name", "restart_service").orderBy("timestamp", "pane_id", "sequence")
    t = (t.withColumn("_s1", F.lag("state", 1).over(w)).withColumn("_s2", F.lag("state", 2).over(w))
         .withColumn("_s3", F.lag("state", 3).over(w)).withColumn("_t3", F.lag("timestamp", 3).over(w)))
    hit = ((F.col("state") == "Starting") & (F.col("_s1") == "Stopping") & (F.col("_s2") == "Running")
           & (F.col("_s3") == "Starting")
           & (F.col("timestamp").cast("double") - F.col("_t3").cast("double") <= width_s))
    return t.where(hit).select("session_name", "restart_service", F.col("_t3").alias("cycle_start"),
                               F.col("timestamp").alias("cycle_end"), "id")
