"""Durable store and upserts with awkward session names and versions."""

import datetime as dt

from pyspark.sql import functions as F

from logweave.functions.text import cut_bytes
from logweave.operators import lifecycle as L
from logweave.sources import sinks as S

BASE = dt.datetime(2024, 1, 10, 12)
SCHEMA = ("id string, session_name string, pane_id string, sequence long, timestamp timestamp, "
          "received_at timestamp, severity string, sev_rank int")


def row(i, session, hours, sequence=1):
    t = BASE + dt.timedelta(hours=hours)
    return (i, session, "p", sequence, t, t, "ERROR", 4)


def test_purge_keeps_every_other_row(spark, tmp_path):
    path = str(tmp_path / "durable")
    rows = [row(f"{s}{h}", s, h) for s in ("007", "008", "a:b", "x=y/z %", None) for h in (-30, 0, 3, 30)]
    df = S.durable_rows(spark.createDataFrame(rows, SCHEMA))
    assert S.append_durable(df, path) == len(rows)
    assert S.append_durable(df, path) == 0
    cutoff = BASE + dt.timedelta(hours=1)
    assert S.purge_before(spark, path, cutoff) == 10
    left = {(r["id"], r["session_name"]) for r in S.stored(spark, path).collect()}
    assert left == {(r[0], r[1]) for r in rows if r[4] >= cutoff}
    assert S.purge_before(spark, path, cutoff) == 0
    got = S.read_range(spark, path, BASE, BASE + dt.timedelta(days=9), session="007").collect()
    assert [r["id"] for r in got] == ["00730", "0073"]


def test_restarted_capture_is_not_dropped(spark, tmp_path):
    path = str(tmp_path / "durable")
    first = S.durable_rows(spark.createDataFrame([row("same", "s", 0)], SCHEMA))
    again = S.durable_rows(spark.createDataFrame([row("same", "s", 2)], SCHEMA))
    assert S.append_durable(first, path) == 1 and S.append_durable(again, path) == 1
    assert S.stored(spark, path).count() == 2


def test_latest_by_id(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), ("c", 3, "p"), ("c", 3, "q"), ("d", None, "m"),
                                ("d", 0, "n")], "id string, updated_at int, v string")
    for d in (df, df.repartition(4)):
        assert sorted((r["id"], r["v"]) for r in S.latest_by_id(d).collect()) == [
            ("a", "y"), ("b", "z"), ("c", "q"), ("d", "n")]


def test_cut_bytes_keeps_characters_whole(spark):
    texts = ["", "abc", "é" * 5, "a中文b", "😀😀", "aé中😀"]
    df = spark.createDataFrame([(t, n) for t in texts for n in range(0, 20)], "t string, n int")
    for t, n, got in df.select("t", "n", cut_bytes(F.col("t"), F.col("n"))).collect():
        want = max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= n), key=len)
        assert got == want


def test_snapshot_trims_all_white_space(spark):
    lines = spark.createDataFrame([("s", "p", 1, BASE, "\t x \u00a0\n"), ("s", "p", 2, BASE, " \t\u2003")],
                                  "session_name string, pane_id string, sequence long, received_at timestamp, raw string")
    assert [r["raw"] for r in L.snapshot_scan(lines, 10).collect()] == ["x"]


def test_pane_and_id_scans_skip_files(spark, tmp_path):
    """A pane between the least and greatest pane of every file: only what its own file
    holds leaves the scan, known by the files' dictionaries and Bloom filters."""
    path = str(tmp_path / "durable")
    for part in range(4):  # panes p000, p004, ... in one file, p001, p005, ... in the next
        rows = [(f"id{i:05d}", "s", f"p{i % 400:03d}", i, BASE + dt.timedelta(seconds=i), BASE, "ERROR", 4)
                for i in range(part, 4000, 4)]
        assert S.append_durable(S.durable_rows(spark.createDataFrame(rows, SCHEMA).coalesce(1)), path) == 1000
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert S.read_pane(spark, path, "p201").count() == 10
        for test, n in (("pane_id = 'p201'", 10), ("pane_id = 'p201x'", 0), ("id = 'id01234'", 1)):
            df = S.stored(spark, path).where(test)
            assert len(df.collect()) == n
            leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
            assert sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())) <= 1000 * (n > 0)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
