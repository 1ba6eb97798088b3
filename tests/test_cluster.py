"""SimHash against a plain Python implementation, banded pairs against all
pairs, leader rounds against the sequential leader scan."""

import random

from pyspark.sql import functions as F

from logweave.functions.simhash import python_simhash, simhash_halves
from logweave.operators import cluster as Cl

TEXTS = ["", "   ", "Failed at Controller.java:45", "Failed at Controller.java:48",
         "connection refused by peer", "Ünïcödé wörds and spaces", "a b c d e f g"]


def test_simhash_matches_python():
    import pandas as pd
    got = simhash_halves(pd.Series(TEXTS))
    for t, (hi, lo) in zip(TEXTS, got.itertuples(index=False)):
        assert (hi << 32) | lo == python_simhash(t)
    assert python_simhash("") == 0


def test_simhash_slices_change_nothing(monkeypatch):
    import pandas as pd

    from logweave.functions import simhash as S
    texts = pd.Series([*TEXTS, None, "long " * 50, *TEXTS])
    whole = simhash_halves(texts)
    monkeypatch.setattr(S, "_SLICE_CHARS", 7)
    assert simhash_halves(texts).equals(whole)
    assert len(simhash_halves(pd.Series([], dtype=object))) == 0


def test_cluster_signature_is_the_leaders(spark):
    vals = [0b0, 0b1, 0b11111, 1 << 40]           # 1 and 1 << 40 are one bit from 0
    rows = [("s", i, v >> 32, v & 0xFFFFFFFF, f"sig{i}") for i, v in enumerate(vals)]
    h = (spark.createDataFrame(rows, "session_name string, rank long, hi long, lo long, first_member string")
         .withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))))
    assign = Cl.leader_rounds(h, Cl.near_duplicate_pairs(h, ["session_name"]), ["session_name"])
    got = {r["h"]: r["signature"] for r in Cl.cluster_signatures(h, assign, ["session_name"]).collect()}
    assert got == {0: "sig0", 1: "sig0", 0b11111: "sig2", 1 << 40: "sig0"}


def test_leader_rounds_without_pairs_and_on_a_chain(spark):
    h = (spark.createDataFrame([(r, 0, v) for r, v in enumerate([0, 0b111, 0b111111, 0b111111111])],
                               "rank long, hi long, lo long").withColumn("h", F.col("lo")))
    alone = Cl.leader_rounds(h, Cl.near_duplicate_pairs(h, [], 2), []).collect()
    assert all(r["is_leader"] and r["leader"] == r["h"] for r in alone) and len(alone) == 4
    chain = Cl.leader_rounds(h, Cl.near_duplicate_pairs(h, []), []).collect()
    assert {r["h"]: r["leader"] for r in chain} == {0: 0, 0b111: 0, 0b111111: 0b111111, 0b111111111: 0b111111}


def test_near_duplicate_in_same_cluster(spark):
    df = spark.createDataFrame([(1, "ERROR Failed at Controller.java:45"),
                                (2, "ERROR Failed at Controller.java:48"),
                                (3, "totally different content here")], "doc_id long, text string")
    codes = Cl.simhash_codes(df, F.col("text"))
    h = Cl.distinct_hashes(codes, [], ["doc_id"], "doc_id")
    assign = Cl.leader_rounds(h, Cl.near_duplicate_pairs(h, []), [])
    lead = {r["doc_id"]: r["leader"] for r in Cl.cluster_members(codes, assign, [], "doc_id").collect()}
    assert lead[1] == lead[2]          # line numbers are normalised away
    assert lead[3] != lead[1]


def random_hashes(n, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.6:
            v = rnd.choice(out)
            for _ in range(rnd.randrange(0, 5)):
                v ^= 1 << rnd.randrange(64)
        else:
            v = rnd.getrandbits(64)
        out.append(v)
    return out


def test_band_join_is_complete(spark):
    vals = sorted(set(random_hashes(400, 11)))
    rows = [(i, v >> 32, v & 0xFFFFFFFF) for i, v in enumerate(vals)]
    h = (spark.createDataFrame(rows, "rank long, hi long, lo long")
         .withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))))
    want = {(a, b) for i, a in enumerate(vals) for b in vals[i + 1:] if bin(a ^ b).count("1") <= 3}
    for cap in (None, 1):        # plain band buckets; every bucket refined once more
        got = {(r["a_hi"] << 32 | r["a_lo"], r["b_hi"] << 32 | r["b_lo"])
               for r in Cl.near_duplicate_pairs(h, [], bucket_cap=cap).collect()}
        assert got == want


def sequential_leaders(order_vals):
    leaders, assign = [], {}
    for v in order_vals:
        if v in assign:
            continue
        hit = next((l for l in leaders if bin(l ^ v).count("1") <= 3), None)
        if hit is None:
            leaders.append(v)
            assign[v] = v
        else:
            assign[v] = hit
    return assign


def test_leader_rounds_equal_sequential_scan(spark):
    seq = random_hashes(300, 5)
    first = {}
    for i, v in enumerate(seq):
        first.setdefault(v, i)
    rows = [(r, v >> 32, v & 0xFFFFFFFF) for v, r in first.items()]
    h = (spark.createDataFrame(rows, "rank long, hi long, lo long")
         .withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))))
    assign = Cl.leader_rounds(h, Cl.near_duplicate_pairs(h, []), []).collect()
    to_u = lambda x: x & 0xFFFFFFFFFFFFFFFF
    got = {to_u(r["h"]): to_u(r["leader"]) for r in assign}
    assert got == sequential_leaders(seq)


def frame_of(spark, seq):
    first = {}
    for i, v in enumerate(seq):
        first.setdefault(v, i)
    rows = [(r, v >> 32, v & 0xFFFFFFFF) for v, r in first.items()]
    return (spark.createDataFrame(rows, "rank long, hi long, lo long")
            .withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))))


def leaders_of(df):
    u = 0xFFFFFFFFFFFFFFFF
    return {r["h"] & u: r["leader"] & u for r in df.collect()}


def test_leader_scan_in_steps_equals_sequential_scan(spark):
    seq = random_hashes(400, 9)
    got = leaders_of(Cl.leader_scan(frame_of(spark, seq), [], dense=-1, first_step=32))
    assert got == sequential_leaders(seq)


def test_dense_family_costs_leaders_not_pairs(spark):
    """20,000 different hashes within three bits of one: the steps see few pairs."""
    rnd = random.Random(3)
    centre = rnd.getrandbits(64)
    family = {centre}
    while len(family) < 20_000:
        family.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    seq = [centre, *rnd.sample(sorted(family - {centre}), len(family) - 1)]
    h = frame_of(spark, seq)
    from logweave.session import materialize
    h = materialize(h)
    assert Cl.candidate_pairs(h, []) > Cl.DENSE * len(family)
    got = leaders_of(Cl.leader_scan(h, [], first_step=64))
    assert got == {v: centre for v in family}
    far = [rnd.choice(seq) ^ (1 << rnd.randrange(64)) for _ in range(600)]  # up to four bits from the centre
    mixed = far + seq[1:1500]
    rnd.shuffle(mixed)
    assert leaders_of(Cl.leader_scan(frame_of(spark, mixed), [], dense=-1, first_step=64)) == sequential_leaders(mixed)


def test_bounded_clusters_keep_most_recent(spark):
    df = spark.createDataFrame([("s", i, i * 10) for i in range(20)], "session_name string, leader long, last long")
    kept = Cl.bounded_clusters(df, ["session_name"], "last", limit=5).collect()
    assert sorted(r["leader"] for r in kept) == [15, 16, 17, 18, 19]
