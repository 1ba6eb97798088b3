"""Anchored windows (W1/W6) and the bucketed sliding count (W9) against
brute-force Python on random input."""

import datetime as dt
import random

import numpy as np

from logweave.operators.fold import anchored_windows, fold_groups, fold_times
from logweave.operators.windows import sliding_count

BASE = dt.datetime(2024, 1, 1)


def brute_anchored(rows, width):
    out, state = {}, {}
    for key, t, seq in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        start, count = state.get(key, (None, 0))
        if start is None or (t - start).total_seconds() > width:
            start, count = t, 1
        else:
            count += 1
        state[key] = (start, count)
        out[(key, seq)] = (start, count)
    return out


def random_rows(n, keys, span_s, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # whole seconds so equal times (ties) and exact-width gaps occur
        rows.append((rnd.choice(keys), BASE + dt.timedelta(seconds=rnd.randrange(span_s)), i))
    return rows


def test_fold_kernel_continues_windows():
    t = np.array([0, 10, 60, 61, 200], dtype=np.int64) * 1_000_000
    st, ct, start, count = fold_times(t[:2], None, 0, 60_000_000)
    st2, ct2, start, count = fold_times(t[2:], start, count, 60_000_000)
    assert list(ct) + list(ct2) == [1, 2, 3, 1, 1]          # exactly 60 s later still counts
    assert list(st2) == [0, 61_000_000, 200_000_000]


def brute_all(rows, width):
    """(start, count, occurrence) of every row."""
    seen, out = {}, {}
    windows = brute_anchored(rows, width)
    for key, t, seq in sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2])):
        seen[key] = seen.get(key, 0) + 1
        out[key, seq] = (*windows[key, seq], seen[key])
    return out


def check_windows(spark, rows, width, **how):
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq long")
    got = anchored_windows(df, ["k"], "ts", ["seq"], width, num_partitions=3, **how).collect()
    want = brute_all(rows, width)
    assert len(got) == len(rows)
    for r in got:
        assert (r["window_start"], r["window_count"], r["occurrence"]) == want[r["k"], r["seq"]]


def test_anchored_windows_match_brute_force(spark):
    # tiny Arrow batches so keys straddle batch boundaries
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = random_rows(600, ["a", "b", "c", None], 900, seed=7)
        # whole keys; chunks of many windows, of one, of a part of one; only 'a' and 'b' hot
        check_windows(spark, rows, 60)
        for chunk_rows in (1000, 20, 3):
            check_windows(spark, rows, 60, hot_rows=0, chunk_rows=chunk_rows)
        check_windows(spark, rows, 60, hot_rows=155, chunk_rows=30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_key_with_and_without_pauses(spark):
    """A key that never pauses beside one with silences of every length, ties included."""
    rnd = random.Random(4)
    rows = [("busy", BASE + dt.timedelta(seconds=i // 2), i) for i in range(1500)]
    t = 0
    for i in range(400):
        t += rnd.choice([0, 0, 1, 5, 9, 10, 11, 30, 70, 200])
        rows.append(("gaps", BASE + dt.timedelta(seconds=t), 5000 + i))
    for chunk_rows in (200, 12):
        check_windows(spark, rows, 10, hot_rows=0, chunk_rows=chunk_rows)


def test_fold_groups_equals_single_folds():
    rnd = np.random.default_rng(1)
    codes = np.sort(rnd.integers(0, 9, 300))
    t = rnd.integers(0, 500, 300) + 10**15
    t = t[np.lexsort((t, codes))]
    starts, counts = fold_groups(codes, t, 10**15 - 5, 3, 40)
    for c in range(9):
        mine = codes == c
        st, ct, _, _ = fold_times(t[mine], 10**15 - 5 if c == 0 else None, 3 if c == 0 else 0, 40)
        assert (starts[mine] == st).all() and (counts[mine] == ct).all()


def test_sliding_count_matches_brute_force(spark):
    rows = random_rows(500, ["x", "y"], 600, seed=3)
    df = spark.createDataFrame([(f"id{s}", k, t) for k, t, s in rows], "id string, k string, ts timestamp")
    got = {r["id"]: r["rate"] for r in sliding_count(df, ["k"], "ts", 60).collect()}
    for k, t, s in rows:
        want = sum(1 for k2, t2, _ in rows if k2 == k and t - dt.timedelta(seconds=60) <= t2 <= t)
        assert got[f"id{s}"] == want
