"""Recurring flag, incidents, alert dedup and the acknowledge/resolve lifecycle."""

import datetime as dt

from pyspark.sql import functions as F

from log_cases import lines_df
from logweave.functions.parse import parse_entries
from logweave.operators import alerts as K
from logweave.operators import incidents as I
from logweave.operators import patterns as Pt
from logweave.operators import windows as W


def entries_of(spark, raws_at):
    return Pt.with_signature(parse_entries(lines_df(spark, [("p", i + 1, t, r) for i, (t, r) in enumerate(raws_at)])))


def test_fifth_hit_is_recurring_and_opens_incident(spark):
    e = entries_of(spark, [(i, "ERROR same failure") for i in range(5)])
    w = Pt.pattern_windows(e, 60)
    counts = sorted(r["window_count"] for r in w.collect())
    assert counts == [1, 2, 3, 4, 5]
    trig = Pt.incident_triggers(w, 5)
    inc = I.incidents(trig).collect()
    assert len(inc) == 1                      # first-seen ERROR and the 5th hit: one incident
    assert inc[0]["entry_count"] == 1 and inc[0]["title"].endswith("(1 occurrences)")
    four = Pt.incident_triggers(Pt.pattern_windows(entries_of(spark, [(i, "WARN again") for i in range(4)]), 60), 5)
    assert four.count() == 0


def test_error_rate_alert_and_global_key(spark):
    e = entries_of(spark, [(i * 3, "ERROR [svc-a] boom") for i in range(15)]
                   + [(100, "ERROR no service here")])
    rates = W.error_rate(e, 60)
    by_key = {}
    for r in rates.collect():
        by_key[r["rate_key"]] = max(by_key.get(r["rate_key"], 0), r["rate"])
    assert by_key["svc-a"] == 15 and by_key["_global"] == 1
    alerts = K.dedup_alerts(K.error_rate_triggers(rates, 60, 10, rate_key=None)).collect()
    assert len(alerts) == 1 and alerts[0]["current_value"] == 15.0 and alerts[0]["trigger_count"] == 6
    assert alerts[0]["message"] == "Error rate 10.0/60s exceeds threshold"


def test_dedup_ack_and_resolve(spark):
    e = entries_of(spark, [(i, "ERROR recurring thing") for i in range(12)])
    w = Pt.pattern_windows(e, 3600)
    trig = K.recurring_triggers(w, 3600, 5)
    once = K.dedup_alerts(trig).collect()
    assert len(once) == 1 and once[0]["status"] == "Active" and once[0]["current_value"] == 12.0
    sig = once[0]["pattern_id"]
    base = dt.datetime(2024, 1, 15, 10, 0, 0)
    acts = spark.createDataFrame(
        [("s", "RecurringError", sig, "acknowledge", base + dt.timedelta(seconds=6, milliseconds=500))],
        "session_name string, alert_type string, key string, action string, at timestamp")
    two = sorted(K.dedup_alerts(trig, acts).collect(), key=lambda r: r["triggered_at"])
    assert [r["status"] for r in two] == ["Acknowledged", "Active"]    # next hit opens a new alert
    assert two[0]["acknowledged_at"] == base + dt.timedelta(seconds=6, milliseconds=500)
    assert [r["trigger_count"] for r in two] == [3, 5]
    acts2 = acts.unionByName(spark.createDataFrame(
        [("s", "RecurringError", sig, "resolve", base + dt.timedelta(seconds=20))], acts.schema))
    final = sorted(K.dedup_alerts(trig, acts2).collect(), key=lambda r: r["triggered_at"])
    assert [r["status"] for r in final] == ["Acknowledged", "Resolved"]


def test_restart_loop(spark):
    e = entries_of(spark, [(0, "[api] Starting api"), (10, "[api] Stopping api"), (20, "[api] Starting api"),
                           (500, "[api] Starting api")])
    loops = W.restart_loops(e, 30).collect()
    assert len(loops) == 1 and loops[0]["transitions"] == 3 and loops[0]["restart_service"] == "api"


def test_strict_restart_cycle(spark):
    e = entries_of(spark, [(0, "[db] Starting db"), (5, "[db] db started"), (10, "[db] Stopping db"),
                           (15, "[db] Starting db"), (100, "[db] Stopping db")])
    cyc = W.restart_cycles(e, 30).collect()
    assert len(cyc) == 1 and cyc[0]["restart_service"] == "db"
    assert W.restart_cycles(e, 10).count() == 0          # the cycle took 15 s


def test_incident_actions_and_auto_resolve(spark):
    e = entries_of(spark, [(i, "ERROR disk full") for i in range(6)] + [(1000, "FATAL other thing")])
    trig = Pt.incident_triggers(Pt.pattern_windows(e, 60), 5)
    base = dt.datetime(2024, 1, 15, 10, 0, 0)
    inc = {r["title"][:14]: r for r in I.incidents(trig).collect()}
    assert all(r["status"] == "Active" for r in inc.values())
    auto = I.incidents(trig, as_of=base + dt.timedelta(seconds=1000), auto_resolve_s=600).collect()
    status = sorted((r["status"], r["resolved_at"]) for r in auto)
    assert status[0][0] == "Active" and status[1] == ("Resolved", base + dt.timedelta(seconds=605))
    sig = [r for r in I.incidents(trig).collect() if r["entry_count"] > 0][0]["signature"]
    acts = spark.createDataFrame([("s", sig, "mitigate", base + dt.timedelta(seconds=50)),
                                  ("s", sig, "resolve", base + dt.timedelta(seconds=70))],
                                 "session_name string, signature string, action string, at timestamp")
    done = [r for r in I.incidents(trig, actions=acts).collect() if r["signature"] == sig][0]
    assert (done["status"], done["resolved_at"]) == ("Resolved", base + dt.timedelta(seconds=70))


def test_stream_alert_events_shape(spark):
    from logweave.streaming.stream import alert_events
    e = entries_of(spark, [(i, "ERROR same") for i in range(6)])
    w = Pt.pattern_windows(e, 60)
    firsts = {r["entry_id"] for r in Pt.first_seen(w).collect()}
    rows = w.withColumn("is_first", F.col("id").isin(list(firsts)))
    ev = sorted((r["alert_type"], r["value"]) for r in alert_events(rows, 5).collect())
    assert ev == [("NewException", 1.0), ("RecurringError", 5.0)]
