"""Registered queries of the streaming forms.

Each writes the log lines as files in the shared folder, a set of files for each stretch of
days, runs the stream over them with ``availableNow`` (a micro-batch a set) and
returns what it stored.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import parse_entries
from ..operators.windows import UNKNOWN_SERVICE
from ..session import checkpoint_dir, materialize
from ..sources.fixtures import log_lines, restarted_lines
from ..sources.sinks import stored
from ..streaming import alerts as SA
from ..streaming import clusters as SC
from ..streaming import sessions as SS
from ..streaming import stream as St
from . import catalog as C

FILES = 2
#: Lines (of actions: people's actions) a file, from which a stretch gets more files.
FILE_ROWS, ACTION_ROWS = 50_000, 500_000
CUTS = [dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21)]
ACK_AT, RESOLVE_AT = dt.datetime(2024, 1, 12), dt.datetime(2024, 1, 20, 12)
RATE_WIDTH, RATE_SLIDE, WATERMARK = "1 day", "6 hours", "1 hour"
PATTERN_TTL_S = 5 * 86400
SILENCE_S = 1800


def folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/logweave-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def state_partitions(spark: SparkSession):
    """A stream keeps the partitions it starts with: no more than the cores can use."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), max(8, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_parts(df: DataFrame, time: str, path: str, files: int, rows: int = FILE_ROWS) -> tuple[str, int]:
    """``df`` as files for each stretch between the cuts, the earliest first: (path, files a stretch).  Every
    stretch has the same number, ``files`` or as many as keep the largest one at about ``rows`` a file, so that
    many files are one micro-batch and its tasks grow with it."""
    spark = df.sparkSession
    df = materialize(df)
    parts = []
    for low, high in zip([None, *CUTS], [*CUTS, None]):
        part = df
        if low is not None:
            part = part.where(F.col(time) >= F.lit(low))
        if high is not None:
            part = part.where(F.col(time) < F.lit(high))
        parts.append(part)
    sizes = [p.count() for p in parts]
    many = max(files, -(-max(sizes) // rows))
    empty = spark.createDataFrame([], df.schema).coalesce(1)
    for part, size in zip(parts, sizes):
        before = _files(spark, path)
        part.repartition(many).write.mode("append").parquet(path)
        for _ in range(_files(spark, path) - before, many if many > files else 0):  # a partition without rows left no file
            empty.write.mode("append").parquet(path)
    return path, many


def _files(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(p)) if fs.exists(p) else 0


def line_files(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    return write_parts(log_lines(spark, sf_dir), "received_at", folder(spark, "lines"), FILES)


def line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, files = line_files(spark, sf_dir)
    return St.parse_stream(St.read_lines(spark, path, max_files_per_trigger=files), WATERMARK)


def run_to_table(df: DataFrame) -> DataFrame:
    """Runs a stream over all that is there and reads what it appended."""
    spark = df.sparkSession
    out = folder(spark, "out")
    with state_partitions(spark):
        q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "stream"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


@C.query
def stream_follow(spark, sf_dir):
    """Two feeds as one stream, filtered as the lines come."""
    lines = log_lines(spark, sf_dir)
    first = F.col("session_name") == "sess-0"
    feeds = [write_parts(lines.where(c), "received_at", folder(spark, "feed"), 1) for c in (first, ~first)]
    both = St.read_lines(spark, feeds[0][0]).unionByName(St.read_lines(spark, feeds[1][0], max_files_per_trigger=feeds[1][1]))
    return run_to_table(St.follow(parse_entries(both), "ERROR").select("id", "pane_id", "sequence", "detected_severity"))


@C.query
def stream_durable(spark, sf_dir):
    """The severe entries of a stream, stored; a second run over the same lines adds none."""
    (lines, files), path = line_files(spark, sf_dir), folder(spark, "durable")
    for _ in range(2):
        entries = St.parse_stream(St.read_lines(spark, lines, max_files_per_trigger=files), WATERMARK)
        St.durable_sink(entries.drop("parsed_fields"), path, folder(spark, "stream")).awaitTermination()
    return stored(spark, path).select("id", "session_name", "severity", "timestamp")


@C.query
def stream_error_rate(spark, sf_dir):
    """Sliding windows that the watermark has closed."""
    return run_to_table(St.error_rate_windows(line_stream(spark, sf_dir), RATE_WIDTH, RATE_SLIDE))


@C.query
def stream_patterns(spark, sf_dir):
    """Keyed pattern state, forgotten ``PATTERN_TTL_S`` after insertion."""
    return run_to_table(St.pattern_state(line_stream(spark, sf_dir), C.PATTERN_WINDOW_S, PATTERN_TTL_S)).select(
        "id", "session_name", "signature", "window_start", "window_count", "occurrence_count", "is_first")


@C.query
def stream_clusters(spark, sf_dir):
    """D4, D5 by micro-batches against stored leaders: the clusters of ``dedup_lines``."""
    path = folder(spark, "clusters")
    SC.cluster_sink(line_stream(spark, sf_dir), path, folder(spark, "stream")).awaitTermination()
    hi, lo = C._split_h(F.col("leader"))
    return SC.stored_clusters(spark, path).select("session_name", hi.alias("leader_hi"), lo.alias("leader_lo"),
                                                  "representative", "last_member", "members", "distinct_hashes")


def person_actions(entries: DataFrame) -> DataFrame:
    """Actions of people for every key that could have an alert: by the first digit of
    the key's digest acknowledged (0 to 7) and resolved (4 to b) at fixed moments."""
    e = C.Pt.with_signature(entries)
    pattern = F.array(F.struct(F.lit("RecurringError").alias("alert_type"), F.col("signature").alias("key")),
                      F.struct(F.lit("NewException").alias("alert_type"), F.col("signature").alias("key")),
                      F.struct(F.lit("ErrorRate").alias("alert_type"), F.lit("").alias("key")),
                      F.struct(F.lit("RestartLoop").alias("alert_type"), F.coalesce("service", F.lit(UNKNOWN_SERVICE)).alias("key")))
    keys = e.select("session_name", F.explode(pattern).alias("_k")).select("session_name", "_k.*").distinct()
    digit = F.substring(F.md5(F.concat_ws("|", "session_name", "alert_type", "key")), 1, 1)

    def act(when, name, at):
        return F.when(when, F.struct(F.lit(name).alias("action"), F.lit(at).alias("at")))

    return keys.select("*", F.explode(F.array_compact(F.array(
        act(digit <= "7", "acknowledge", ACK_AT), act(digit.between("4", "b"), "resolve", RESOLVE_AT)))).alias("_a")).select(
        "session_name", "alert_type", "key", "_a.*")


@C.query
def stream_alerts(spark, sf_dir):
    """K1-K6, K8: all four alert types with dedup, acknowledge, resolve and re-opening as keyed state."""
    acts = person_actions(C.entries(spark, sf_dir))
    path, files = write_parts(acts, "at", folder(spark, "actions"), 1, ACTION_ROWS)
    actions = spark.readStream.schema(acts.schema).option("maxFilesPerTrigger", files).parquet(path)
    rules = SA.Rules(C.PATTERN_WINDOW_S, C.RECURRING_THRESHOLD, C.RATE_WINDOW_S, C.RATE_THRESHOLD, C.RESTART_WINDOW_S, 2)
    versions = run_to_table(SA.alert_versions(line_stream(spark, sf_dir), actions, rules))
    return SA.alert_table(versions).select(
        "id", "session_name", "alert_type", "pattern_id", "threshold", "current_value", "triggered_at", "acknowledged_at",
        "status", "message", "severity", "trigger_count")


def restarted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of restarted captures as a stream, the watermark on their arrival."""
    lines, files = write_parts(restarted_lines(spark, sf_dir), "received_at", folder(spark, "lines"), FILES)
    return parse_entries(St.read_lines(spark, lines, max_files_per_trigger=files).withWatermark("received_at", WATERMARK))


@C.query
def stream_collapse(spark, sf_dir):
    """Entries closed by the next start or by silence."""
    return run_to_table(SS.collapse_stream(restarted_stream(spark, sf_dir), SILENCE_S))


@C.query
def stream_liveness(spark, sf_dir):
    """L4 as events."""
    return run_to_table(SS.liveness_events(restarted_stream(spark, sf_dir), C.STALE_AFTER_S, C.DISCONNECT_AFTER_S))


@C.query
def stream_cycle(spark, sf_dir):
    """W8."""
    return run_to_table(SS.cycle_stream(restarted_stream(spark, sf_dir), C.CYCLE_WINDOW_S))
