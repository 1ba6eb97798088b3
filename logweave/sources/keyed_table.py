"""A stored table with one row a key, merged batch by batch.

Rows are dealt by a hash of the key into buckets, a folder each.  A batch reads the buckets
its keys fall into, combines old and new rows, writes these buckets as new folders and
then a manifest that names the folder of every bucket and the last batch.  Nothing that a
reader could see is changed in place: a batch that fails before its manifest is complete leaves the
table as it was, and a batch that is repeated (its number not above the manifest's)
does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sequence import join_keys
from ..session import materialize
from .sinks import _exists

BUCKETS = 64


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str) -> tuple[int, int, int | None, dict[int, str]]:
    """(version, last batch, number of buckets, bucket -> folder) of the newest complete
    manifest; a manifest has a row a bucket."""
    if not _exists(spark, f"{path}/manifest"):
        return 0, -1, None, {}
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = sorted((int(s.getPath().getName().removeprefix("v")) for s in fs.listStatus(p)
                       if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), reverse=True)
    if not versions:
        return 0, -1, None, {}
    rows = spark.read.json(f"{path}/manifest/v{versions[0]}", schema="bucket int, folder string, batch long, buckets int").collect()
    return versions[0], rows[0]["batch"], rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["folder"] is not None}


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows as of the newest manifest (None: no batch yet)."""
    folders = _manifest(spark, path)[3]
    return spark.read.parquet(*sorted(folders.values())) if folders else None


def merge_batch(batch: DataFrame, path: str, keys: list[str], number: int, combine: Callable[[DataFrame], DataFrame],
                buckets: int = BUCKETS) -> bool:
    """Merge ``batch`` into the table; ``combine`` reduces old and new rows together to one a key
    (same columns).  Returns False for a batch that is already in.  ``buckets`` is fixed by the
    first batch and kept in the manifest."""
    spark = batch.sparkSession
    version, last, made, folders = _manifest(spark, path)
    if number <= last:
        return False
    buckets = made or buckets
    new = combine(batch).withColumn("_bucket", _bucket(keys, buckets))
    data = f"{path}/data/{uuid.uuid4().hex}"
    new.write.partitionBy("_bucket").parquet(f"{data}/new")
    new = spark.read.schema(new.schema).parquet(f"{data}/new")
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # at most ``buckets``
    old = [folders[b] for b in touched if b in folders]
    rows = new.drop("_bucket")
    if old:
        rows = combine(rows.unionByName(spark.read.parquet(*old)))
    (rows.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket")
     .write.partitionBy("_bucket").parquet(f"{data}/merged"))
    folders |= {b: f"{data}/merged/_bucket={b}" for b in touched}
    listed = [(b, f, number, buckets) for b, f in sorted(folders.items())] or [(0, None, number, buckets)]
    (spark.createDataFrame(listed, "bucket int, folder string, batch long, buckets int").coalesce(1)
     .write.mode("overwrite").json(f"{path}/manifest/v{version + 1}"))
    return True


def unknown_keys(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The different keys of ``batch`` that no stored row has.  Only the buckets that
    these keys fall into are read."""
    spark = batch.sparkSession
    mine = batch.select(*keys).distinct()
    _, _, buckets, folders = _manifest(spark, path)
    if not folders:
        return mine
    mine = materialize(mine.withColumn("_bucket", _bucket(keys, buckets)))
    touched = [r["_bucket"] for r in mine.select("_bucket").distinct().collect()]  # at most ``buckets``
    known = [folders[b] for b in touched if b in folders]
    mine = mine.drop("_bucket")
    return join_keys(mine, spark.read.parquet(*known).select(*keys), keys, "left_anti") if known else mine
