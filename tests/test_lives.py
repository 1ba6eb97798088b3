"""Leaders of bounded life: families of long chains, leaders that are born again, scopes."""

import datetime as dt
import random

from logweave.operators import lives as L

BASE = dt.datetime(2024, 1, 1)


def test_families_of_a_long_chain_write_rows_in_proportion(spark, monkeypatch):
    nodes = random.Random(5).sample(range(10**6), 400)  # a path through all, in no order
    pairs = spark.createDataFrame([(s, a, b) for s in ("x", None) for a, b in zip(nodes, nodes[1:])], "s string, a long, b long")
    written = []
    keep = L.materialize

    def counted(df):
        out = keep(df)
        written.append(out.count() if out.columns[-1] != "family" else 0)  # the labels: one row a hash
        return out

    monkeypatch.setattr(L, "materialize", counted)
    got = L.families(pairs, ["s"]).collect()
    assert len(got) == 800 and {r["family"] for r in got} == {min(nodes)}
    assert sum(written) < 8 * 800 and len(written) < 40


def sequential(rows, ttl):
    live, out = [], {}
    for t, i, h in sorted(rows):
        live = [x for x in live if x[1] >= t - ttl]
        hit = next((x for x in live if (x[0] ^ h).bit_count() <= 3), None)
        if hit is None:
            hit = (h, t)
            live.append(hit)
        out[i] = hit
    return out


def lives_of(spark, rows, ttl):
    df = spark.createDataFrame([(s, i, h, h >> 32, h & 0xFFFFFFFF, BASE + dt.timedelta(seconds=t), "p", i) for s, t, i, h in rows],
                               "session_name string, id long, h long, hi long, lo long, timestamp timestamp, pane_id string, sequence long")
    got = L.leader_lives(df.cache(), ["session_name"], ["pane_id", "sequence"], ttl).collect()
    return {r["id"]: (r["leader"], int((r["led_at"] - BASE).total_seconds())) for r in got}


def test_a_leader_that_is_born_again_is_younger_than_others(spark):
    # 0 leads from 0 to 10; 0b11111 (far from 0, near 0b111) leads from 8; 0 is born again at 11
    rows = [(0, 0, 0), (1, 1, 0b111), (8, 2, 0b11111), (11, 3, 0), (12, 4, 0b111), (30, 5, 0b111), (31, 6, 0)]
    want = sequential(rows, 10)
    assert want[4] == (0b11111, 8) and want[1] == (0, 0) and want[6] == (0b111, 30)
    assert lives_of(spark, [("s", *r) for r in rows], 10) == want


def test_lives_of_scopes_with_null_and_small_batches(spark):
    rng = random.Random(17)
    centre = rng.getrandbits(62)
    some = [centre ^ sum(1 << p for p in rng.sample(range(62), rng.choice([0, 1, 2, 3]))) for _ in range(40)]
    rows = [(rng.choice(["a", "b", None]), rng.randrange(500), i, rng.choice(some)) for i in range(600)]
    want = {}
    for s in ("a", "b", None):
        want |= sequential([r[1:] for r in rows if r[0] == s], 40)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        assert lives_of(spark, rows, 40) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
