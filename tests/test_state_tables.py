"""Stream state and stored tables: repeated and interrupted batches, bounded leaders, alert
episodes, leader lives, context selection, implied text filters."""

import datetime as dt
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from log_cases import lines_df
from logweave.functions.parse import parse_entries
from logweave.operators import cluster as Cl
from logweave.operators import filters as Fl
from logweave.operators import patterns as Pt
from logweave.operators.lives import leader_lives
from logweave.plans import reports
from logweave.sources.keyed_table import merge_batch, read_table, unknown_keys
from logweave.sources.sinks import latest_by_id
from logweave.streaming import alerts as SA
from logweave.streaming import clusters as SC

BASE = dt.datetime(2024, 1, 1)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


# ---- alert episodes ------------------------------------------------------------

def batch_rule(triggers, actions):
    """Episodes by the number of actions at or before a trigger; an action belongs to the alert
    opened last at or before it."""
    groups = {}
    for t, v in triggers:
        groups.setdefault(sum(a <= t for a, _ in actions), []).append((t, v))
    alerts = [{"at": g[0][0], "value": g[-1][1], "count": len(g)} for _, g in sorted(groups.items())]
    for i, a in enumerate(alerts):
        end = alerts[i + 1]["at"] if i + 1 < len(alerts) else None
        mine = [x for x in actions if x[0] >= a["at"] and (end is None or x[0] < end)]
        a["ack"] = min([x for x, n in mine if n == "acknowledge"], default=None)
        a["done"] = min([x for x, n in mine if n == "resolve"], default=None)
    return alerts


def test_alert_track_over_batches_equals_the_batch_rule():
    rng = random.Random(1)
    for _ in range(400):
        triggers = sorted((rng.randrange(30), rng.randrange(100)) for _ in range(rng.randrange(12)))
        triggers = [(t, float(i)) for i, (t, _) in enumerate(triggers)]
        actions = sorted((rng.randrange(30), rng.choice(["acknowledge", "resolve"])) for _ in range(rng.randrange(5)))
        cuts = sorted(rng.sample(range(31), rng.randrange(4)))
        seen, body = {}, None
        for low, high in zip([0, *cuts], [*cuts, 31]):
            track = SA.Track(body)
            part = [(t, v) for t, v in triggers if low <= t < high]
            track.advance(SA.Triggers(np.array([t for t, _ in part], dtype=np.int64), np.array([v for _, v in part]),
                                      lambda i: ("m", "ERROR")), [a for a in actions if low <= a[0] < high])
            body = track.body()
            seen |= {k: dict(a) for k, a in track.changed.items()}
        got = [{k: seen[t][k] for k in ("at", "value", "count", "ack", "done")} for t in sorted(seen)]
        assert got == batch_rule(triggers, actions)


# ---- stored leaders --------------------------------------------------------------

def test_cluster_batches_with_a_repeat_equal_one_batch(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, k=8)) for _ in range(12)]
    rows = [("p", i, i, rng.choice(texts) + rng.choice(["", " tail", " end of line", " more"])) for i in range(90)]
    e = parse_entries(lines_df(spark, rows)).cache()
    path = str(tmp_path / "clusters")
    cut = F.col("received_at") - F.lit(dt.datetime(2024, 1, 15, 10))
    parts = [e.where(cut < F.expr("INTERVAL 30 SECONDS")),
             e.where((cut >= F.expr("INTERVAL 30 SECONDS")) & (cut < F.expr("INTERVAL 60 SECONDS"))),
             e.where(cut >= F.expr("INTERVAL 60 SECONDS"))]
    for i in (0, 1, 1, 2):  # batch 1 runs twice
        SC.cluster_batch(parts[i], path, i)
    codes = Cl.simhash_codes(e.select("id", "session_name", "timestamp", "pane_id", "sequence", "raw_content"), F.col("raw_content"))
    h = Cl.distinct_hashes(codes, ["session_name"], Pt.ORDER, "id").cache()
    want = Cl.cluster_stats(Cl.leader_scan(h, ["session_name"]), ["session_name"])
    cols = ["leader", "representative", "last_member", "members", "distinct_hashes"]

    def rows_of(df):
        return sorted(tuple(r) for r in df.select(cols).collect())

    assert rows_of(SC.stored_clusters(spark, path)) == rows_of(want)


def test_stored_leaders_end_by_age_and_by_number(spark, tmp_path):
    def batch(i, start):
        return parse_entries(lines_df(spark, [("p", i * 10 + k, start + k, t) for k, t in enumerate(
            ["alpha beta gamma delta", "one two three four five", "red green blue yellow pink"])]))

    def leaders(path):
        return spark.read.parquet(f"{path}/leaders").groupBy("batch").count().orderBy("batch").collect()

    for name, how, want in (("none", {}, {0: 3}), ("ttl", {"ttl_s": 60}, {0: 3, 2: 3}), ("cap", {"cap": 2}, None)):
        path = str(tmp_path / name)
        for i, start in enumerate([0, 30, 300]):
            SC.cluster_batch(batch(i, start), path, i, **how)
        got = {r["batch"]: r["count"] for r in leaders(path)}
        if want is None:  # the oldest of three leaders is gone when the second batch comes
            assert got[0] == 3 and got[1] == 1
        else:
            assert got == want


# ---- keyed table ------------------------------------------------------------------

def test_keyed_table_repeats_and_interruptions(spark, tmp_path):
    path = str(tmp_path / "table")

    def versions(rows):
        return spark.createDataFrame(rows, "id string, v long, updated_at long")

    def rows():
        return sorted(tuple(r) for r in read_table(spark, path).collect())

    one, two = versions([("a", 1, 1), ("b", 1, 1), (None, 5, 1)]), versions([("a", 2, 2), ("c", 1, 2), ("b", 0, 0)])
    assert read_table(spark, path) is None and unknown_keys(one, path, ["id"]).count() == 3
    assert merge_batch(one, path, ["id"], 0, latest_by_id, buckets=4)
    # a batch that stopped before its manifest was complete
    os.makedirs(f"{path}/manifest/v2")
    assert len(read_table(spark, path).collect()) == 3
    assert sorted(r["id"] for r in unknown_keys(two, path, ["id"]).collect()) == ["c"]
    # only the buckets of the asked keys are read
    files = unknown_keys(one.limit(1), path, ["id"]).inputFiles()
    assert len([f for f in files if "/merged/" in f]) == 1
    assert merge_batch(two, path, ["id"], 1, latest_by_id, buckets=4)
    want = sorted([("a", 2, 2), ("b", 1, 1), ("c", 1, 2), (None, 5, 1)], key=repr)
    assert sorted(map(tuple, read_table(spark, path).collect()), key=repr) == want
    assert not merge_batch(two, path, ["id"], 1, latest_by_id, buckets=4)
    assert not merge_batch(versions([("a", 9, 9)]), path, ["id"], 0, latest_by_id, buckets=4)
    assert sorted(map(tuple, read_table(spark, path).collect()), key=repr) == want
    empty = str(tmp_path / "empty")
    assert merge_batch(one.limit(0), empty, ["id"], 3, latest_by_id) and read_table(spark, empty) is None


# ---- leader lives -------------------------------------------------------------------

def sequential_lives(rows, ttl):
    live, out = [], {}
    for t, i, h in sorted(rows):
        live = [x for x in live if x[1] >= t - ttl]
        hit = next((x for x in live if bin(x[0] ^ h).count("1") <= 3), None)
        if hit is None:
            hit = (h, t)
            live.append(hit)
        out[i] = hit
    return out


@pytest.mark.parametrize("ttl", [15, 200])
def test_leader_lives_equal_the_sequential_rule(spark, ttl):
    rng = random.Random(ttl)
    base = [rng.getrandbits(62) for _ in range(12)]
    hashes = [b ^ sum(1 << p for p in rng.sample(range(62), rng.choice([0, 0, 1, 2, 3]))) for b in base for _ in range(3)]
    hashes += [rng.getrandbits(62) for _ in range(6)]
    rows = [(rng.randrange(400), i, rng.choice(hashes)) for i in range(500)]
    df = spark.createDataFrame([("s", i, h, h >> 32, h & 0xFFFFFFFF, at(t), "p", i) for t, i, h in rows],
                               "session_name string, id long, h long, hi long, lo long, timestamp timestamp, pane_id string, sequence long")
    got = {r["id"]: (r["leader"], int((r["led_at"] - BASE).total_seconds()))
           for r in leader_lives(df.cache(), ["session_name"], ["pane_id", "sequence"], ttl).collect()}
    assert got == sequential_lives(rows, ttl)


# ---- reports and filters ----------------------------------------------------------------

def test_context_selection_fits_the_budget(spark):
    rng = random.Random(2)
    items = [("s" if i % 3 else "t", "entry", rng.randint(1, 3), rng.randint(0, 6), at(rng.randrange(50)), f"i{i}", "x" * rng.randrange(60))
             for i in range(200)]
    df = spark.createDataFrame(items, "session_name string, kind string, priority int, sev_rank int, at timestamp, item_id string, text string")
    got = reports.context_selection(df, 150).collect()
    for s in ("s", "t"):
        order = sorted((r for r in items if r[0] == s), key=lambda r: (r[2], -r[3], -r[4].timestamp(), r[5]))
        want, total = [], 0
        for r in order:
            total += max(1, -(-len(r[6]) // 4))
            if total > 150:
                break
            want.append(r[5])
        mine = sorted((r["position"], r["item_id"]) for r in got if r["session_name"] == s)
        assert [i for _, i in mine] == want and want


def test_implied_text_filter_loses_no_line(spark):
    raws = ["ERROR [api] boom", '{"level":"err","service":"api","message":"x"}', '{"level":"\\u0045RROR","service":"api"}',
            'level="E\\RR" service=api', "level=error service=api é", "INFO [api] fine", "ERROR [web] other", "plain text"]
    lines = lines_df(spark, [("p", i, i, r) for i, r in enumerate(raws)])
    for severity, service in (("ERROR", "api"), ("ERROR", None), (None, "api"), ("UNKNOWN", None)):
        whole = Fl.entries_query(parse_entries(lines), severity=severity, service=service)
        first = Fl.entries_query(parse_entries(Fl.lines_of(lines, severity, service)), severity=severity, service=service)
        assert sorted(r["raw_content"] for r in first.collect()) == sorted(r["raw_content"] for r in whole.collect())
    kept = Fl.lines_of(lines, "ERROR", "api").count()
    assert kept < len(raws)
    plan = parse_entries(Fl.lines_of(lines, "ERROR", "api"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("CollectMetrics")  # the test lies under the parse


def test_ids_differ_for_shared_panes_and_restarts(spark):
    from logweave.operators import windows as W
    rows = [("s1", "p", 1, at(0), "ERROR a"), ("s2", "p", 1, at(0), "ERROR a"), ("s1", "p", 1, at(9), "ERROR a"),
            ("s1", "p", 1, at(9), "ERROR a")]
    from logweave.streaming.stream import LOG_LINES_SCHEMA
    e = parse_entries(spark.createDataFrame(rows, LOG_LINES_SCHEMA))
    assert e.select("id").distinct().count() == 3
    rates = sorted((r["session_name"], r["rate"]) for r in W.error_rate(e, 60).collect())
    assert rates == [("s1", 1), ("s1", 3), ("s1", 3), ("s2", 1)]
    w = Pt.pattern_windows(Pt.with_signature(e), 60)
    from logweave.operators import incidents as I
    assert [r["entry_count"] for r in I.incidents(Pt.incident_triggers(w, 5)).collect()] == [0, 0]
