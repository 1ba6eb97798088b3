"""Ring buffer, retention, buffer stats, liveness and the durable sink."""

import datetime as dt


from log_cases import lines_df
from logweave.functions.parse import parse_entries
from logweave.operators import aggregates as A
from logweave.operators import lifecycle as L
from logweave.sources import sinks as S

BASE = dt.datetime(2024, 1, 15, 10, 0, 0)


def test_ring_keeps_newest(spark):
    e = parse_entries(lines_df(spark, [("p", i, i, f"line {i}") for i in range(10)]))
    assert sorted(r["sequence"] for r in L.ring_last_n(e, 5).collect()) == [5, 6, 7, 8, 9]


def test_buffer_utilisation(spark):
    e = parse_entries(lines_df(spark, [("p", i + 1, i, "x") for i in range(50)]))
    r = A.buffer_stats(e, 100).first()
    assert (r["panes"], r["entries"], r["capacity"], r["utilization_pct"]) == (1, 50, 100, 50.0)
    assert A.buffer_stats(e, 0).first()["utilization_pct"] == 0.0


def test_retention_prefix_and_exact(spark):
    # lines in the order of arrival; the times they tell are 09:55:00, 10:00:00 and 09:53:20
    rows = [("p", 1, 0, "2024-01-15T09:55:00Z old"), ("p", 2, 1, "2024-01-15T10:00:00Z new"),
            ("p", 3, 2, "2024-01-15T09:53:20Z old but after a new one")]
    e = parse_entries(lines_df(spark, rows))
    as_of = BASE
    assert sorted(r["sequence"] for r in L.retention_trim(e, as_of, 60).collect()) == [2, 3]
    assert sorted(r["sequence"] for r in L.retention_trim(e, as_of, 60, exact=True).collect()) == [2]


def test_liveness(spark):
    rows = [("p", 1, 0, "a"), ("p", 2, 10, "b"), ("p", 3, 4000, "c")]
    e = parse_entries(lines_df(spark, rows))
    r = L.session_liveness(e, BASE + dt.timedelta(seconds=4010), 3600, 7200).first()
    assert (r["stale_gaps"], r["disconnect_gaps"], r["status"]) == (1, 0, "Active")


def test_durable_append_is_idempotent_and_purges(spark, tmp_path):
    rows = [("p", i + 1, i * 3600 * 6, lvl + " event") for i, lvl in enumerate(["ERROR", "INFO", "FATAL", "ERROR"])]
    e = parse_entries(lines_df(spark, rows))
    path = str(tmp_path / "durable")
    d = S.durable_rows(e)
    assert S.append_durable(d, path) == 3
    assert S.append_durable(d, path) == 0                    # replay writes nothing
    got = S.read_range(spark, path, BASE, BASE + dt.timedelta(days=1))
    assert [r["sequence"] for r in got.collect()] == [4, 3, 1]  # newest first
    assert S.purge_before(spark, path, BASE + dt.timedelta(hours=13)) == 2
    assert [r["sequence"] for r in spark.read.parquet(path).collect()] == [4]


def test_entry_counters_observed_without_extra_pass(spark):
    from pyspark.sql import Observation
    rows = [("p", 1, 0, "ERROR a"), ("p", 2, 1, "INFO b"), ("p", 3, 2, "no level here")]
    obs = Observation("counters")
    e = A.entry_counters(parse_entries(lines_df(spark, rows)), obs)
    assert e.count() == 3
    assert obs.get == {"parsed": 3, "errors": 2, "unparsed_time": 3}
