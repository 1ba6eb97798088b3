"""Pattern tracking.

A pattern is a (session, signature) key; the signature is the exact D1
signature by default, or any other key column (e.g. a cluster leader).
Order inside a key is event time, then pane and sequence.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import LEVELS, RANK
from ..functions.text import exact_signature
from .fold import anchored_windows

ORDER = ["timestamp", "pane_id", "sequence"]


def level_of(rank: Column) -> Column:
    """Rank 0..6 -> level name."""
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def order_struct() -> Column:
    return F.struct(*[F.col(c) for c in ORDER])


def with_signature(entries: DataFrame, col: str = "signature") -> DataFrame:
    """D1 exact signature of every entry."""
    return entries.withColumn(col, exact_signature(F.col("raw_content")))


def pattern_rollup(entries: DataFrame, key: str = "signature") -> DataFrame:
    """Per (session, key) count, first/last seen, highest severity
    (UNKNOWN ranks highest) and the first entry as sample."""
    first = F.min_by(F.struct("id", "raw_content"), order_struct())
    return (entries.groupBy("session_name", key).agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.max("sev_rank").alias("_r"), first.alias("_s"))
        .select("session_name", key, level_of(F.col("_r")).alias("severity"), "first_seen", "last_seen",
                "occurrence_count", F.col("_s.id").alias("sample_entry"),
                F.col("_s.raw_content").alias("sample_message")))


def pattern_samples(entries: DataFrame, key: str = "signature") -> DataFrame:
    """The sample line of every (session, key), its first entry, taken in the
    roll-up itself (no look-up by id)."""
    first = F.min_by(F.struct(F.col("id").alias("sample_entry"), "pane_id", "sequence",
                              F.col("raw_content").alias("sample_message")), order_struct())
    return entries.groupBy("session_name", key).agg(first.alias("_s")).select("session_name", key, "_s.*")


def first_seen(entries: DataFrame, key: str = "signature") -> DataFrame:
    """The first entry of every (session, key): aggregate, not a window,
    so a hot key costs one partial row per task."""
    first = F.min_by(F.struct("id", "timestamp", "severity", "sev_rank", "service"), order_struct())
    return (entries.groupBy("session_name", key).agg(first.alias("_f"))
            .select("session_name", key, F.col("_f.id").alias("entry_id"),
                    F.col("_f.timestamp").alias("first_seen"), F.col("_f.severity").alias("severity"),
                    (F.col("_f.sev_rank") >= RANK["ERROR"]).alias("is_new_error")))


def partial_rollup(entries: DataFrame, key: str = "signature") -> DataFrame:
    """A6 as mergeable parts: one row a (session, key) that ``merge_rollups`` adds up."""
    return (entries.groupBy("session_name", key).agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.max("timestamp").alias("last_seen"), F.max("sev_rank").alias("sev_rank"),
        F.min(F.struct(*ORDER)).alias("first"), F.min_by(F.struct("id", "raw_content"), order_struct()).alias("sample")))


def merge_rollups(parts: DataFrame, key: str = "signature") -> DataFrame:
    """Parts of several batches as one part a (session, key)."""
    return parts.groupBy("session_name", key).agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.max("last_seen").alias("last_seen"),
        F.max("sev_rank").alias("sev_rank"), F.min_by("sample", "first").alias("sample"), F.min("first").alias("first"))


def finish_rollup(parts: DataFrame, key: str = "signature") -> DataFrame:
    """The pattern table of merged parts."""
    return parts.select("session_name", key, level_of(F.col("sev_rank")).alias("severity"), F.col("first.timestamp").alias("first_seen"),
                        "last_seen", "occurrence_count", F.col("sample.id").alias("sample_entry"),
                        F.col("sample.raw_content").alias("sample_message"))


def pattern_windows(entries: DataFrame, width_s: int, key: str = "signature") -> DataFrame:
    """Place of every entry in its anchored window and in its pattern
    (``occurrence`` 1: first seen)."""
    cols = ["id", "session_name", key, "timestamp", "pane_id", "sequence", "severity", "sev_rank", "service"]
    return anchored_windows(entries.select(*cols), ["session_name", key], "timestamp",
                            ["pane_id", "sequence"], width_s)


def recurring_windows(windows: DataFrame, threshold: int, key: str = "signature") -> DataFrame:
    """W2 per window: windows whose count reaches ``threshold`` with the time it did."""
    g = windows.groupBy("session_name", key, "window_start").agg(
        F.max("window_count").alias("window_count"),
        F.min(F.when(F.col("window_count") == threshold, F.col("timestamp"))).alias("recurring_at"),
        F.max("timestamp").alias("last_seen"))
    return g.where(F.col("window_count") >= threshold)


def incident_triggers(windows: DataFrame, threshold: int) -> DataFrame:
    """Rows that are recurring (count >= threshold) or the first of their
    pattern with rank >= ERROR (UNKNOWN included)."""
    is_first = F.col("occurrence") == 1
    trig = (F.col("window_count") >= threshold) | (is_first & (F.col("sev_rank") >= RANK["ERROR"]))
    return windows.withColumn("is_first", is_first).where(trig)


def top_patterns(patterns: DataFrame, k: int = 10, key: str = "signature") -> DataFrame:
    """The ``k`` most frequent patterns per session (ties: first seen, key)."""
    w = Window.partitionBy("session_name").orderBy(F.desc("occurrence_count"), "first_seen", key)
    return patterns.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def entries_for_patterns(entries: DataFrame, patterns: DataFrame, key: str = "signature") -> DataFrame:
    """Member entries of the given patterns (equi-join on session and key;
    AQE splits a hot key's partition of the large side)."""
    return entries.join(patterns.select("session_name", key), ["session_name", key])


def pattern_lifecycle(windows: DataFrame, as_of: dt.datetime, threshold: int = 5,
                      recurring_after_s: int = 300, resolved_after_s: int = 600,
                      key: str = "signature") -> DataFrame:
    """W11 at ``as_of``: New (never reached the threshold), Active (reached it),
    Recurring (reached it and kept occurring for ``recurring_after_s`` after),
    Resolved (reached it, then quiet for ``resolved_after_s``)."""
    g = windows.groupBy("session_name", key).agg(
        F.min(F.when(F.col("window_count") >= threshold, F.col("timestamp"))).alias("active_since"),
        F.max("timestamp").alias("last_seen"), F.count(F.lit(1)).alias("occurrence_count"))
    span = F.col("last_seen").cast("double") - F.col("active_since").cast("double")
    quiet = F.lit(as_of).cast("double") - F.col("last_seen").cast("double")
    state = (F.when(F.col("active_since").isNull(), F.lit("New"))
             .when(quiet >= resolved_after_s, F.lit("Resolved"))
             .when(span >= recurring_after_s, F.lit("Recurring"))
             .otherwise(F.lit("Active")))
    return g.withColumn("state", state)
