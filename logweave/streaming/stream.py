"""Structured Streaming forms of the pipeline.

``read_lines`` -> ``parse_stream`` (the batch parser, a watermark on event
time) -> sinks:
* ``follow``: stateless F3 filter (append);
* ``durable_sink``: S4 via ``foreachBatch`` with an anti-join on the entry id,
  so a micro-batch replayed after a failure writes nothing twice;
* ``pattern_state``: W1-W3 as keyed state with ``applyInPandasWithState``, a group
  for a bucket of signatures; the state is the window start, window count
  and occurrence count of each, optionally expiring ``ttl_s`` after the signature's
  insertion (D6, event-time timeout);
* ``alert_events``: K8, recurring and new-exception events as they happen (all four
  types with dedup and actions: ``alerts.py``; clusters: ``clusters.py``);
* ``error_rate_windows``: W9/W10 as sliding event-time windows; state older
  than the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parse import parse_entries
from ..functions.severity import RANK
from ..functions.text import exact_signature
from ..operators.filters import line_filter
from ..operators.fold import NO_WINDOW, fold_keys
from ..sources.sinks import append_durable, durable_rows

LOG_LINES_SCHEMA = T.StructType([
    T.StructField("session_name", T.StringType()), T.StructField("pane_id", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("received_at", T.TimestampType()),
    T.StructField("raw", T.StringType())])

PATTERN_STATE_OUT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("session_name", T.StringType()),
    T.StructField("signature", T.StringType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("pane_id", T.StringType()), T.StructField("sequence", T.LongType()),
    T.StructField("severity", T.StringType()), T.StructField("sev_rank", T.IntegerType()),
    T.StructField("window_start", T.TimestampType()), T.StructField("window_count", T.LongType()),
    T.StructField("occurrence_count", T.LongType()), T.StructField("is_first", T.BooleanType())])

#: Arrays of equal length, a place a signature of the bucket.
PATTERN_STATE = T.StructType([
    T.StructField("signatures", T.ArrayType(T.StringType())), T.StructField("window_start_us", T.ArrayType(T.LongType())),
    T.StructField("window_count", T.ArrayType(T.LongType())), T.StructField("occurrences", T.ArrayType(T.LongType())),
    T.StructField("inserted_us", T.ArrayType(T.LongType()))])

#: Buckets a session that its signatures share their state in; fixed for the life of a checkpoint.
PATTERN_BUCKETS = 256


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """An unbounded ``log_lines`` table from files landing in ``path``
    (one source for all panes; separate feeds can be ``unionByName``-ed)."""
    r = spark.readStream.format(fmt).schema(LOG_LINES_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def parse_stream(lines: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """The batch parser on a stream, with an event-time watermark."""
    return parse_entries(lines).withWatermark("timestamp", watermark)


def follow(entries: DataFrame, min_level: str = "ERROR", pattern: str | None = None) -> DataFrame:
    """the F1 filter on the live stream (stateless)."""
    return line_filter(entries, min_level, pattern)


def durable_sink(entries: DataFrame, path: str, checkpoint: str, min_level: str = "ERROR",
                 trigger: dict | None = None):
    """Append high-severity rows to the partitioned durable table.
    Idempotent per micro-batch (anti-join on the entry id)."""
    def write(batch: DataFrame, batch_id: int) -> None:
        append_durable(durable_rows(batch, min_level), path)
    w = entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _pattern_fold(width_us: int, ttl_us: int | None):
    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, *kept = state.get if state.exists else ([], [], [], [], [])
        known, kept = np.array(known, dtype=object), [np.array(x, dtype=np.int64) for x in kept]
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches), ignore_index=True)
            if pdf.empty:
                return
            # places of the signatures in the state, new ones behind the known (NULL has a place, too)
            place, names = pd.factorize(np.concatenate([known, pdf["signature"].to_numpy(dtype=object)]), use_na_sentinel=False)
            pdf["_key"] = place[len(known):]
            pdf = pdf.sort_values(["_key", "timestamp", "pane_id", "sequence"], kind="stable", ignore_index=True)
            mine, codes = np.unique(pdf["_key"].to_numpy(), return_inverse=True)
            fresh = len(names) - len(known)
            kept = [np.concatenate([x, np.full(fresh, NO_WINDOW if i in (0, 3) else 0)]) for i, x in enumerate(kept)]
            start, count, occ, born = (x[mine] for x in kept)
            t = pdf["timestamp"].to_numpy(dtype="datetime64[us]").astype(np.int64)
            heads = np.flatnonzero(np.diff(codes, prepend=-1))
            # lives of a signature: a line later than its insertion + ttl inserts it anew
            if ttl_us is not None:
                lives = fold_keys(codes, t, born, np.zeros_like(born), ttl_us)[0]
            else:
                lives = np.where(born == NO_WINDOW, t[heads], born)[codes]
            begins = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(lives, prepend=lives[0]) != 0))
            life = np.zeros(len(t), dtype=np.int64)
            life[begins[1:]] = 1
            life = np.cumsum(life)
            of = codes[begins]
            goes_on = lives[begins] == born[of]
            starts, counts = fold_keys(life, t, np.where(goes_on, start[of], NO_WINDOW), np.where(goes_on, count[of], 0), width_us)
            occurrence = np.where(goes_on, occ[of], 0)[life] + np.arange(len(t)) - begins[life] + 1
            lasts = np.append(heads[1:], len(t)) - 1
            for x, new in zip(kept, (starts, counts, occurrence, lives)):
                x[mine] = new[lasts]
            known = np.array([None if pd.isna(x) else x for x in names], dtype=object)
        if ttl_us is not None:  # no line that is still to come can be of a life that ended before the watermark
            lives_on = kept[3] + ttl_us >= state.getCurrentWatermarkMs() * 1000
            known, kept = known[lives_on], [x[lives_on] for x in kept]
        if len(known):
            state.update((known.tolist(), *(x.tolist() for x in kept)))
            if ttl_us is not None:
                state.setTimeoutTimestamp(max(int(kept[3].min()) + ttl_us, state.getCurrentWatermarkMs() * 1000 + 1000) // 1000 + 1)
        elif state.exists:
            state.remove()
        if state.hasTimedOut:
            return
        out = pdf[["id", "session_name", "signature", "timestamp", "pane_id", "sequence", "severity", "sev_rank"]].copy()
        out["window_start"] = pd.to_datetime(starts, unit="us")
        out["window_count"] = counts
        out["occurrence_count"] = occurrence
        out["is_first"] = occurrence == 1
        yield out
    return fold


def pattern_state(entries: DataFrame, width_s: int, ttl_s: int | None = None) -> DataFrame:
    """W1-W3 on a stream: state of every (session, signature), kept by buckets of
    signatures: a task calls Python once a bucket, not once a signature, and folds all
    signatures of a bucket at once.

    Rows of a key inside one micro-batch are folded in event order; the state
    carries the open window to the next batch.  Equal to the batch fold when
    lines arrive in event order across micro-batches (a line older than the
    open window is counted where it arrives; older than the watermark, it is
    dropped).  ``ttl_s`` (D6) forgets a
    signature ``ttl_s`` after its insertion (event time; needs the watermark).
    """
    s = entries.withColumn("signature", exact_signature(F.col("raw_content"))).select(
        "id", "session_name", "signature", "timestamp", "pane_id", "sequence", "severity", "sev_rank",
        F.pmod(F.xxhash64("signature"), F.lit(PATTERN_BUCKETS)).alias("_bucket"))
    timeout = GroupStateTimeout.EventTimeTimeout if ttl_s is not None else GroupStateTimeout.NoTimeout
    return s.groupBy("session_name", "_bucket").applyInPandasWithState(
        _pattern_fold(int(width_s) * 1_000_000, None if ttl_s is None else int(ttl_s) * 1_000_000),
        PATTERN_STATE_OUT, PATTERN_STATE, "append", timeout)


def alert_events(pattern_rows: DataFrame, threshold: int) -> DataFrame:
    """K8: an event when a window reaches the threshold (RecurringError) and
    when a pattern is first seen at ERROR or above (NewException)."""
    rec = pattern_rows.where(F.col("window_count") == threshold).select(
        "session_name", F.lit("RecurringError").alias("alert_type"), "signature", "timestamp",
        F.col("window_count").cast("double").alias("value"))
    new = pattern_rows.where(F.col("is_first") & (F.col("sev_rank") >= RANK["ERROR"])).select(
        "session_name", F.lit("NewException").alias("alert_type"), "signature", "timestamp",
        F.lit(1.0).alias("value"))
    return rec.unionByName(new)


def error_rate_windows(entries: DataFrame, width: str = "1 minute", slide: str = "10 seconds",
                       include_unknown: bool = True) -> DataFrame:
    """Error lines per sliding event-time window, session and service
    (``_global`` without a service); windows behind the watermark are final
    and their state is dropped."""
    cond = F.col("sev_rank") >= RANK["ERROR"]
    if not include_unknown:
        cond = cond & (F.col("severity") != "UNKNOWN")
    return (entries.where(cond)
            .groupBy("session_name", F.coalesce(F.col("service"), F.lit("_global")).alias("rate_key"),
                     F.window("timestamp", width, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("errors"))
            .select("session_name", "rate_key", F.col("w.start").alias("window_start"),
                    F.col("w.end").alias("window_end"), "errors"))
