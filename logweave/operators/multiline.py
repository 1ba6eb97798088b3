"""Multi-line entries (P16) and validation columns.

P16 folds continuation lines into the entry they continue.  The group of a
line is the place, by arrival, of the last start line at or before it in its
(session, pane).  That running maximum is computed per (pane, hour of arrival) chunk,
with the carry-in from earlier chunks taken from a small per-chunk table,
so no window ever spans a whole pane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FUTURE_SKEW_SECONDS, MAX_CONTENT_BYTES, TRUNCATION_MARKER, cut_bytes
from .sequence import arrival_positions, join_keys

# --- fixed values -------------------------------------------------------------
# Java-style stack-trace continuation lines.
CONTINUATION = r"^(\s|at |Caused by:|\.\.\. \d+ more)"
# -----------------------------------------------------------------------------


def multiline_groups(entries: DataFrame, starts: Column | None = None) -> DataFrame:
    """Adds ``_pos``, the place of each line in its (session, pane) by arrival, ``_group``, the place
    of the start line it belongs to, and ``group_start``, that line's sequence.
    A continuation line with no start before it in its pane starts a group."""
    is_start = starts if starts is not None else ~F.col("raw_content").rlike(CONTINUATION)
    pane = ["session_name", "pane_id"]
    t = arrival_positions(entries, "raw_content").withColumns({
        "_chunk": F.date_trunc("hour", F.col("received_at")),
        "_start": F.when(is_start, F.struct("_pos", "sequence"))})
    w = Window.partitionBy(*pane, "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_local", F.max("_start").over(w))
    per_chunk = t.groupBy(*pane, "_chunk").agg(F.max("_start").alias("_last"))
    carry = per_chunk.select(*pane, "_chunk", F.max("_last").over(
        Window.partitionBy(*pane).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    t = join_keys(t, carry, [*pane, "_chunk"])
    # a continuation line with no start before it stands for itself
    group = F.coalesce(F.col("_local"), F.col("_carry"), F.struct("_pos", "sequence"))
    return (t.withColumns({"_group": group["_pos"], "group_start": group["sequence"]})
            .drop("_chunk", "_start", "_local", "_carry"))


def collapse_multiline(entries: DataFrame, starts: Column | None = None) -> DataFrame:
    """One row per multi-line entry: first line's id, earliest time, the
    lines joined by newlines in the order of arrival, and the line count.
    ``group_start`` and ``last_sequence`` are the counters of its first and last line;
    after a restart of the capture they may repeat in a pane."""
    g = multiline_groups(entries, starts)
    return g.groupBy("session_name", "pane_id", "_group").agg(
        F.min_by("group_start", "_pos").alias("group_start"),
        F.min_by("id", "_pos").alias("id"), F.min("timestamp").alias("timestamp"),
        F.count(F.lit(1)).alias("line_count"), F.max_by("sequence", "_pos").alias("last_sequence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "raw_content"))),
                                 lambda x: x["raw_content"]), "\n").alias("content")).drop("_group")


def validate_entries(entries: DataFrame) -> DataFrame:
    """Future-skew flag (time > arrival + 5 s), sequence-regression flag
    (not above that of the line that arrived before it), oversize flag and the
    content cut to 10 KB with a marker."""
    key = ["session_name", "pane_id", "_pos"]
    placed = arrival_positions(entries, "raw_content")
    prev = placed.select("session_name", "pane_id", (F.col("_pos") + 1).alias("_pos"),
                         F.col("sequence").alias("_prev_sequence"))
    v = join_keys(placed, prev, key, "left")
    oversize = F.octet_length("raw_content") > MAX_CONTENT_BYTES
    return v.select(
        "id", "session_name", "pane_id", "sequence",
        (F.col("timestamp") > F.col("received_at") + F.expr(f"INTERVAL {FUTURE_SKEW_SECONDS} SECONDS"))
        .alias("future_skew"),
        F.coalesce(F.col("_prev_sequence") >= F.col("sequence"), F.lit(False)).alias("sequence_regression"),
        oversize.alias("oversize"),
        F.when(oversize, F.concat(cut_bytes(F.col("raw_content"), F.lit(MAX_CONTENT_BYTES)), F.lit(TRUNCATION_MARKER)))
        .otherwise(F.col("raw_content")).alias("content"))
