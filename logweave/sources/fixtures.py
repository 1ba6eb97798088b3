"""Input tables.

``log_lines`` (session_name, pane_id, sequence, received_at, raw) is the
input contract of the engine.  The test data has no log table, so the lines
are rendered from ``events`` by one fixed rule set (the same rule is written
in SQL for the DuckDB oracle, see ``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import number_rows
from ..session import ensure_utc

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a source that arrives in fewer partitions than there are
    cores (e.g. one small file with one row group); a large table already
    has enough splits and is left alone (no extra shuffle)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, spread over the cores when the file has too few splits."""
    return spread(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def render_log_lines(events: DataFrame, number: bool = True) -> DataFrame:
    """Render ``events`` rows into raw log lines (FIXTURES.md part C).

    Fixed rendering rules: session ``sess-<user_id % 3>``, pane
    ``pane-<user_id % 12>``, service ``svc-<user_id % 7>``; level by event
    type; message by ``event_id % 6``; layout by ``(event_id div 6) % 6``.
    """
    e = events.select(
        "event_id", "user_id", "event_type", "value",
        F.col("ts").cast("timestamp").alias("received_at"))
    eid, m = F.col("event_id"), F.col("event_id") % 6
    e = e.withColumn("_svc", F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string")))
    svc, level, msg = F.col("_svc"), F.col("_level"), F.col("_msg")
    e = e.withColumn("_level", F.when(F.col("event_type") == "error",
                    F.when(F.col("value") < 50, F.lit("ERROR")).otherwise(F.lit("FATAL")))
             .when(F.col("event_type") == "signup", F.lit("WARN"))
             .when(F.col("event_type") == "purchase", F.lit("INFO"))
             .when(F.col("event_type") == "click", F.lit("DEBUG"))
             .when(F.col("event_type") == "view", F.lit("TRACE"))
             .otherwise(F.lit("INFO")))
    # a column each, as six layouts use them: generated code grows with every use of an expression
    e = e.withColumn("_msg", F.when(m == 0, F.concat(F.lit("Connection refused to db at localhost:"),
                                   (F.lit(5000) + eid % 50).cast("string")))
           .when(m == 1, F.concat(F.lit("NullPointerException at Handler.java:"),
                                  (F.lit(10) + eid % 90).cast("string")))
           .when(m == 2, F.concat(F.lit("Starting "), svc))
           .when(m == 3, F.concat(F.lit("Stopping "), svc, F.lit(" (SIGTERM)")))
           .when(m == 4, F.concat(F.lit("request took ms="), (eid % 900).cast("string")))
           .otherwise(F.concat(F.lit("segfault at 0x"),
                               F.substring(F.md5(eid.cast("string")), 1, 12))))
    ts = F.col("received_at")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    std = F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS")
    syslog = F.date_format(ts, "MMM dd HH:mm:ss")
    k = (eid % 100).cast("string")
    lay = F.floor(eid / 6) % 6
    raw = (F.when(lay == 0, F.concat(iso, F.lit(" ["), svc, F.lit("] "), level, F.lit(": "), msg))
           .when(lay == 1, F.concat(F.lit('{"timestamp":"'), iso, F.lit('","level":"'), F.lower(level),
                                    F.lit('","service":"'), svc, F.lit('","message":"'), msg,
                                    F.lit('","k":'), k, F.lit("}")))
           .when(lay == 2, F.concat(F.lit("ts="), iso, F.lit(" level="), F.lower(level),
                                    F.lit(" service="), svc, F.lit(' msg="'), msg, F.lit('" k='), k))
           .when(lay == 3, F.concat(std, F.lit(" "), level, F.lit(" service="), svc, F.lit(" "), msg))
           .when(lay == 4, F.concat(syslog, F.lit(" "), svc, F.lit(" "), msg))
           .otherwise(msg))
    lines = e.select(
        F.concat(F.lit("sess-"), (F.col("user_id") % 3).cast("string")).alias("session_name"),
        F.concat(F.lit("pane-"), (F.col("user_id") % 12).cast("string")).alias("pane_id"),
        "event_id", "received_at", raw.alias("raw"))
    if not number:
        return lines
    lines = number_rows(lines, ["pane_id"], ["received_at", "event_id"],
                        F.date_trunc("hour", F.col("received_at")), "sequence")
    return lines.select("session_name", "pane_id", "sequence", "received_at", "raw")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return render_log_lines(table(spark, sf_dir, "events"))


def render_restarted_lines(events: DataFrame) -> DataFrame:
    """``events`` as lines of captures that restart every day (their counters begin at 1
    again), of sessions that share pane ids, and of one session that falls silent.

    Fixed rendering rules: session ``sess-old`` for ``user_id % 5 = 4`` before January
    10, else ``sess-<user_id % 4>``; pane ``pane-<user_id % 6>``; message by ``event_id % 7``
    (one is a stack-trace line); layout by ``(event_id div 7) % 4``, JSON levels are numbers.
    """
    eid, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    svc = F.concat(F.lit("svc-"), (F.col("user_id") % 7).cast("string"))
    level = (F.when(F.col("event_type") == "error", F.lit("ERROR")).when(F.col("event_type") == "signup", F.lit("WARN"))
             .otherwise(F.lit("INFO")))
    m = eid % 7
    msg = (F.when(m == 0, F.concat(F.lit("Connection refused to db at localhost:"), (5000 + eid % 50).cast("string")))
           .when(m == 1, F.concat(F.lit("NullPointerException at Handler.java:"), (10 + eid % 90).cast("string")))
           .when(m == 2, F.concat(F.lit("Starting "), svc)).when(m == 3, F.concat(svc, F.lit(" ready")))
           .when(m == 4, F.concat(F.lit("Stopping "), svc))
           .otherwise(F.concat(F.lit("request took ms="), (eid % 900).cast("string"))))
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    lay = F.floor(eid / 7) % 4
    raw = (F.when(m == 5, F.concat(F.lit("    at com.example.Handler.run(Handler.java:"), (eid % 9).cast("string"), F.lit(")")))
           .when(lay == 0, F.concat(iso, F.lit(" ["), svc, F.lit("] "), level, F.lit(": "), msg))
           .when(lay == 1, F.concat(F.lit('{"time":"'), iso, F.lit('","level":'), (eid % 60).cast("string"),
                                    F.lit(',"service":"'), svc, F.lit('","msg":"'), msg, F.lit('"}')))
           .when(lay == 2, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" "), level, F.lit(" service="),
                                    svc, F.lit(" "), msg))
           .otherwise(msg))
    old = (F.col("user_id") % 5 == 4) & (ts < F.lit("2024-01-10").cast("timestamp"))
    lines = events.select(
        F.when(old, F.lit("sess-old")).otherwise(F.concat(F.lit("sess-"), (F.col("user_id") % 4).cast("string"))).alias("session_name"),
        F.concat(F.lit("pane-"), (F.col("user_id") % 6).cast("string")).alias("pane_id"), "event_id",
        ts.alias("received_at"), F.to_date(ts).alias("day"), raw.alias("raw"))
    return number_rows(lines, ["session_name", "pane_id", "day"], ["received_at", "event_id"],
                       F.date_trunc("hour", F.col("received_at")), "sequence").select(
        "session_name", "pane_id", "sequence", "received_at", "raw")


def restarted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_utc(spark)
    return render_restarted_lines(table(spark, sf_dir, "events"))
