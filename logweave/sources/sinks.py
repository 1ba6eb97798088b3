"""Durable high-severity store (S4-S6, J6, L1) and the newest version of each id.

The durable table is Parquet partitioned by ``session_name`` and ``date``:
range scans prune partitions and push the time/severity predicates into
the row-group statistics.  Appends are idempotent: rows already stored are dropped by an anti-join against the keys of the touched
partitions only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import RANK
from ..operators.sequence import join_keys
from ..session import materialize

DURABLE_PARTITIONS = ["session_name", "date"]
BLOOM_COLUMNS = ["id", "pane_id"]


def durable_rows(entries: DataFrame, min_level: str = "ERROR", include_unknown: bool = True) -> DataFrame:
    """S4 gate: rows at or above ``min_level`` (UNKNOWN ranks highest)."""
    cond = F.col("sev_rank") >= RANK[min_level]
    if not include_unknown:
        cond = cond & (F.col("severity") != "UNKNOWN")
    return entries.where(cond).withColumn("date", F.to_date("timestamp"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The durable table.  Partition values are read with explicit types, so a
    session named ``007`` stays text."""
    types = {"session_name": T.StringType(), "date": T.DateType()}
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([
        T.StructField(f.name, types.get(f.name, f.dataType), True) for f in found.fields])).parquet(path)


def append_durable(rows: DataFrame, path: str) -> int:
    """Append new rows; rows already stored are skipped.  Returns rows
    written.  A row is known by its id, session and arrival: the capture
    counter behind the id starts again with each capture."""
    spark = rows.sparkSession
    key = [c for c in ("id", "session_name", "received_at") if c in rows.columns]
    rows = materialize(rows.dropDuplicates(key))  # read twice below: the parse runs once
    if _exists(spark, path):
        touched = rows.select(*DURABLE_PARTITIONS).distinct()
        have = join_keys(stored(spark, path), touched, DURABLE_PARTITIONS, "left_semi").select(*key)
        rows = materialize(join_keys(rows, have, key, "left_anti"))
    n = rows.count()
    if n:
        # time order in the files gives narrow row-group ranges; a pane or id scan skips by Bloom filters
        out = rows.sortWithinPartitions(*DURABLE_PARTITIONS, "timestamp").write.mode("append")
        for c in BLOOM_COLUMNS:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.partitionBy(*DURABLE_PARTITIONS).parquet(path)
    return n


def read_range(spark: SparkSession, path: str, since: dt.datetime, until: dt.datetime,
               severity: str | None = None, session: str | None = None) -> DataFrame:
    """``since <= timestamp <= until`` (inclusive), optional severity, newest first."""
    df = stored(spark, path).where(
        (F.col("date") >= F.lit(since.date())) & (F.col("date") <= F.lit(until.date()))
        & (F.col("timestamp") >= F.lit(since)) & (F.col("timestamp") <= F.lit(until)))
    if severity is not None:
        df = df.where(F.col("severity") == severity)
    if session is not None:
        df = df.where(F.col("session_name") == session)
    return df.orderBy(F.desc("timestamp"), "pane_id", "sequence")


def read_pane(spark: SparkSession, path: str, pane_id: str) -> DataFrame:
    """One pane, newest first."""
    return (stored(spark, path).where(F.col("pane_id") == pane_id)
            .orderBy(F.desc("timestamp"), F.desc("sequence")))


def purge_before(spark: SparkSession, path: str, cutoff: dt.datetime) -> int:
    """L1: delete rows with ``timestamp < cutoff``; returns how many.

    Only the partition folders that hold old rows are touched, known by the
    files these rows were read from.  The rows that stay in them (also those
    without a time) are written to the shared folder first, then back with
    dynamic partition overwrite; folders without any are removed.
    """
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    df = stored(spark, path).withColumn("_folder", folder)
    gone = F.coalesce(F.col("timestamp") < F.lit(cutoff), F.lit(False))
    folders = materialize(df.groupBy("_folder").agg(F.count_if(gone).alias("_old"), F.count_if(~gone).alias("_kept"))
                          .where("_old > 0"))
    n = folders.agg(F.sum("_old")).first()[0] or 0
    if n == 0:
        return 0
    keep = materialize(df.join(folders.where("_kept > 0").select("_folder"), "_folder", "left_semi")
                       .where(~gone).drop("_folder"))
    keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *DURABLE_PARTITIONS).parquet(path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    # one row per emptied (session, day): bounded by sessions x calendar days
    for r in folders.where("_kept = 0").toLocalIterator():
        part = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(r["_folder"]))
        part.getFileSystem(conf).delete(part, True)
    spark.catalog.refreshByPath(path)
    return int(n)


def latest_by_id(df: DataFrame, id_col: str = "id", version_col: str = "updated_at") -> DataFrame:
    """Upsert semantics as a read: the newest version of each id wins; a
    NULL version is the oldest, ties go to the greatest row as JSON text."""
    row = F.struct(*df.columns)
    return (df.groupBy(F.col(id_col).alias("_id"))
            .agg(F.max_by(row, F.struct(F.col(version_col), F.to_json(row))).alias("_row")).select("_row.*"))
