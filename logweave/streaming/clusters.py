"""Leader clusters on a stream (D4, D5, D6) over stored tables.

State lives in two tables of the shared folder, a folder for each micro-batch:
``leaders`` (the hashes that opened a cluster, with their place in the order of arrival) and
``hashes`` (what the batch saw: its different hashes with their leader, first and last line and
number of lines).  A micro-batch joins its different hashes with the stored leaders by band key;
what is near none goes through leader rounds, whose leaders are stored.  A batch reads the
leaders of earlier batches only and overwrites its own two folders, so a batch that is
repeated after a failure changes nothing.

The order of arrival is (batch, event time, pane, sequence); many micro-batches give the
clusters of one batch when lines arrive in event order across micro-batches.

Bounded memory (D6): with ``ttl_s`` a leader takes lines up to ``ttl_s`` after its insertion
(measured from the start of a batch: the batch's earliest line), with ``cap`` the oldest leaders of a session go when more
than ``cap`` are stored; a later line then opens a cluster of its own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cluster as Cl
from ..operators import patterns as Pt
from ..session import materialize
from ..sources.sinks import _exists

SCOPE = ["session_name"]


def _leaders(spark: SparkSession, path: str, batch: int, since: dt.datetime | None, cap: int | None) -> DataFrame | None:
    """Leaders of the batches before ``batch`` that still live."""
    if not _exists(spark, f"{path}/leaders"):
        return None
    known = spark.read.parquet(f"{path}/leaders").where(F.col("batch") < batch)
    if since is not None:
        known = known.where(F.col("rank.timestamp") >= F.lit(since))
    known = known.withColumn("rank", F.struct("batch", "rank"))
    if cap is not None:  # FIFO; a group limit: each task ships ``cap`` rows a session
        newest = Window.partitionBy(*SCOPE).orderBy(F.desc("rank"), "h")
        known = known.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= cap).drop("_n")
    return None if known.isEmpty() else known.drop("batch")


def cluster_batch(entries: DataFrame, path: str, batch: int, ttl_s: int | None = None, cap: int | None = None) -> None:
    """One micro-batch of parsed entries into the tables under ``path``."""
    spark = entries.sparkSession
    e = entries.select("id", *SCOPE, "timestamp", "pane_id", "sequence", "raw_content")
    codes = Cl.simhash_codes(e, F.col("raw_content")).drop("raw_content")
    hashes = materialize(Cl.distinct_hashes(codes, SCOPE, Pt.ORDER, "id"))
    since = None
    if ttl_s is not None:
        first = hashes.agg(F.min("rank.timestamp")).first()[0]
        since = first - dt.timedelta(seconds=ttl_s) if first else None
    leaders = _leaders(spark, path, batch, since, cap)
    if leaders is None:
        done = materialize(Cl.leader_scan(hashes, SCOPE))
    else:
        done = Cl.cluster_step(hashes, leaders, SCOPE)
    (done.where("is_leader").select(*SCOPE, "h", "hi", "lo", "rank")
     .write.mode("overwrite").parquet(f"{path}/leaders/batch={batch}"))
    (done.select(*SCOPE, "h", "leader", "rank", "last_rank", "first_member", "last_member", "members")
     .write.mode("overwrite").parquet(f"{path}/hashes/batch={batch}"))


def cluster_sink(entries: DataFrame, path: str, checkpoint: str, ttl_s: int | None = None, cap: int | None = None,
                 trigger: dict | None = None):
    """Starts the stream of parsed entries into the tables under ``path``."""
    w = entries.writeStream.foreachBatch(lambda batch, i: cluster_batch(batch, path, i, ttl_s, cap))
    return w.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stored_clusters(spark: SparkSession, path: str) -> DataFrame:
    """D5/D8 of all batches so far: the counts of a hash in several batches are added, its
    first and last line taken over all of them."""
    per = (spark.read.parquet(f"{path}/hashes").groupBy(*SCOPE, "h", "leader").agg(
        F.min_by("first_member", "rank").alias("first_member"), F.max_by("last_member", "last_rank").alias("last_member"),
        F.sum("members").alias("members"), F.max("last_rank").alias("last_rank"), F.min("rank").alias("rank")))
    return Cl.cluster_stats(per, SCOPE)
