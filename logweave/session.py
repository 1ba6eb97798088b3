"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "logweave",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators assume.

    UTC session time (all timestamps are UTC), AQE on (coalescing and skew
    join), Arrow for pandas UDFs, UI off.  On a cluster ``master`` stays
    ``None`` so the launcher decides.
    """
    b = SparkSession.builder.appName(app)
    if master:
        # local mode: the driver JVM is the only executor
        b = b.master(master).config("spark.driver.memory", os.environ.get("LOGWEAVE_DRIVER_MEMORY", "16g"))
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:  # otherwise the cluster's own setting stands
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Settings the parser relies on.

    All parsing and rendering is defined in UTC, and a repeated key in a
    JSON object or key=value list keeps its last value (as in the parsed
    formats) instead of failing the job.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.mapKeyDedupPolicy") != "LAST_WIN":
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Without one, a local session (one JVM, no separate executors) gets a
    private folder of its own; on a cluster this is an error, because a
    folder of one machine would hold only that machine's part of a table.
    The caller's session settings are not changed.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="logweave-ckpt-")
    return _LOCAL_DIRS[app]


def materialize(df, **options):
    """Cut lineage by writing ``df`` as a Parquet table under the shared
    ``spark.checkpoint.dir`` and reading it back.

    Computed once; the write goes through AQE (partition sizes from the
    data) and the read-back is split by file size, so small intermediates
    become few partitions and large ones stay parallel; readers also get
    column pruning and predicate pushdown.  A lost executor recomputes
    nothing upstream of the table.  ``options`` go to the writer."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/logweave-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
