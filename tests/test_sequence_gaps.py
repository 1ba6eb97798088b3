"""Operators on panes whose sequence has gaps or repeats."""

import datetime as dt

from log_cases import lines_df
from pyspark.sql import functions as F

from logweave.functions.parse import parse_entries
from logweave.operators import filters as Fl
from logweave.operators import lifecycle as L
from logweave.operators.multiline import validate_entries

GAPPY = [("p", 10 * k, 10 * k, f"line {k} {'panic' if k == 3 else 'ok'}") for k in range(1, 6)]


def test_gappy_sequences(spark):
    e = parse_entries(lines_df(spark, GAPPY))
    assert sorted(r["sequence"] for r in L.ring_last_n(e, 3).collect()) == [30, 40, 50]
    assert sorted(r["sequence"] for r in L.snapshot_scan(lines_df(spark, GAPPY), 2).collect()) == [40, 50]
    near = Fl.context_lines(e, F.col("raw_content").contains("panic"), 1).collect()
    assert sorted((r["sequence"], r["is_match"]) for r in near) == [(20, False), (30, True), (40, False)]
    live = L.session_liveness(e, dt.datetime(2024, 1, 15, 10, 1), 5, 60).first()
    assert (live["lines"], live["stale_gaps"], live["disconnect_gaps"]) == (5, 4, 0)


def test_repeated_sequences_are_flagged_once(spark):
    e = parse_entries(lines_df(spark, [("p", 1, 0, "a"), ("p", 1, 1, "b"), ("p", 2, 2, "c"), ("p", 1, 3, "d")]))
    got = sorted((r["content"], r["sequence_regression"]) for r in validate_entries(e).collect())
    assert got == [("a", False), ("b", True), ("c", False), ("d", True)]
