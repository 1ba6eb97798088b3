"""The streaming forms give the batch results on the same lines."""

import os

from pyspark.sql import functions as F

from log_cases import SMALL
from logweave.functions.parse import parse_entries
from logweave.operators import patterns as Pt
from logweave.sources.fixtures import log_lines
from logweave.streaming import stream as St


def test_stream_equals_batch(spark, tmp_path):
    lines = log_lines(spark, SMALL).withColumn("_day", F.dayofmonth("received_at")).cache()
    src = str(tmp_path / "lines")
    # files in arrival order, one per group of days, several micro-batches
    for lo in range(1, 32, 7):
        part = lines.where((F.col("_day") >= lo) & (F.col("_day") < lo + 7)).drop("_day")
        # one file per chunk, in arrival order: the file source takes files
        # oldest first, so micro-batches follow event time
        part.coalesce(1).sortWithinPartitions("received_at").write.parquet(os.path.join(src, f"chunk={lo:02d}"))
    batch_lines = lines.drop("_day")

    entries = St.parse_stream(St.read_lines(spark, src + "/*", max_files_per_trigger=1), "1 hour")
    q = (St.pattern_state(entries, 86400).writeStream.format("parquet")
         .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["id"]: (r["window_start"], r["window_count"], r["is_first"])
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    w = Pt.pattern_windows(Pt.with_signature(parse_entries(batch_lines)), 86400)
    firsts = {r["entry_id"] for r in Pt.first_seen(w).collect()}
    want = {r["id"]: (r["window_start"], r["window_count"], r["id"] in firsts) for r in w.collect()}
    assert got == want

    dq = St.durable_sink(entries, str(tmp_path / "durable"), str(tmp_path / "ck2"))
    dq.awaitTermination()
    n_batch = parse_entries(batch_lines).where("sev_rank >= 4").count()
    assert spark.read.parquet(str(tmp_path / "durable")).count() == n_batch


def test_follow_filter_equals_batch(spark, tmp_path):
    from logweave.operators.filters import line_filter
    lines = log_lines(spark, SMALL)
    src = str(tmp_path / "lines")
    lines.coalesce(2).write.parquet(src)
    entries = St.parse_stream(St.read_lines(spark, src), "1 hour")
    q = (St.follow(entries, "ERROR", "refused|segfault").select("id", "detected_severity")
         .writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in line_filter(parse_entries(lines), "ERROR", "refused|segfault")
                  .select("id", "detected_severity").collect())
    assert got == want and len(got) > 0
