"""Near pairs by band buckets: what is shuffled, spread buckets, chunks that end inside buckets, scopes."""

import random

from pyspark.sql import functions as F
from test_cluster import random_hashes, sequential_leaders

from logweave.operators import bands as B
from logweave.operators import cluster as Cl

U = 0xFFFFFFFFFFFFFFFF


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def nodes_of(spark, vals, scopes=2):
    return spark.createDataFrame([(i % scopes, i, signed(v)) for i, v in enumerate(vals)], "_sid long, _at long, h long")


def brute(vals, scopes=2):
    return {(i, j) for i, a in enumerate(vals) for j in range(i + 1, len(vals))
            if i % scopes == j % scopes and (a ^ vals[j]).bit_count() <= 3}


def test_a_hash_is_shuffled_four_times_not_sixteen(spark):
    vals = sorted(set(random_hashes(200, 3)))
    assert B.bucket_rows(nodes_of(spark, vals)).count() == 4 * len(vals)


def test_pairs_with_spread_buckets_and_cut_chunks(spark, monkeypatch):
    vals = list(dict.fromkeys(random_hashes(500, 4)))
    want = brute(vals)
    assert len(want) > 50
    monkeypatch.setattr(B, "CHUNK_ROWS", 7)
    monkeypatch.setattr(B, "OUT_ROWS", 3)
    for most, cap in ((1000, 2000), (2, 2000), (2, 1), (1000, 1)):
        monkeypatch.setattr(B, "BUCKET_ROWS", most)
        got = [(r["src"], r["dst"]) for r in B.near_pairs(nodes_of(spark, vals), 3, cap).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_known_hashes_against_others(spark, monkeypatch):
    vals = list(dict.fromkeys(random_hashes(400, 6)))
    vals += vals[:6]  # equal to a known one
    known = spark.createDataFrame([(i % 2, i, signed(v), int(i < 100)) for i, v in enumerate(vals)],
                                  "_sid long, _at long, h long, _known int")
    want = {(i, j) for i in range(100) for j in range(100, len(vals)) if i % 2 == j % 2 and (vals[i] ^ vals[j]).bit_count() <= 3}
    for most, cap in ((1000, 2000), (2, 1)):
        monkeypatch.setattr(B, "BUCKET_ROWS", most)
        got = [(r["src"], r["dst"]) for r in B.near_pairs(known, 3, cap, cross=True).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_scan_of_scopes_with_null_equals_sequential_scan(spark):
    rnd = random.Random(8)
    seqs = {s: list(dict.fromkeys(random_hashes(150, k))) for k, s in enumerate(["a", None, "b"], 20)}
    rows = [(s, r, v >> 32, v & 0xFFFFFFFF) for s, seq in seqs.items() for r, v in enumerate(seq)]
    rnd.shuffle(rows)
    h = (spark.createDataFrame(rows, "s string, rank long, hi long, lo long")
         .withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo"))))
    for dense in (Cl.DENSE, -1):
        got = Cl.leader_scan(h, ["s"], dense=dense, first_step=32).collect()
        assert len(got) == len(rows)
        for s, seq in seqs.items():
            assert {r["h"] & U: r["leader"] & U for r in got if r["s"] == s} == sequential_leaders(seq)


def test_step_after_known_leaders(spark):
    seq = list(dict.fromkeys(random_hashes(300, 12)))
    want = sequential_leaders(seq)
    early = seq[:120]

    def frame(vals, start):
        df = spark.createDataFrame([("s", start + r, v >> 32, v & 0xFFFFFFFF) for r, v in enumerate(vals)],
                                   "s string, rank long, hi long, lo long")
        return df.withColumn("h", F.shiftleft("hi", 32).bitwiseOR(F.col("lo")))

    leaders = frame([v for v in early if want[v] == v], 0)
    got = Cl.cluster_step(frame(seq[120:], 1000), leaders, ["s"]).collect()
    assert {r["h"] & U: r["leader"] & U for r in got} == {v: want[v] for v in seq[120:]}
