"""Streams whose cost does not grow with Python calls: buckets of keys, whole panes, many files a micro-batch."""

import datetime as dt
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd

from logweave.operators.fold import NO_WINDOW, fold_keys, fold_times
from logweave.plans import stream_catalog as S
from logweave.streaming import alerts as SA
from logweave.streaming.sessions import CollapseProcessor
from logweave.streaming.stream import _pattern_fold


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


def started(processor):
    value = Value()
    processor.init(SimpleNamespace(getValueState=lambda *_: value, registerTimer=lambda *_: None))
    return processor


def test_fold_keys_is_fold_times_of_every_key():
    r = np.random.default_rng(1)
    for _ in range(100):
        k = int(r.integers(1, 6))
        codes = np.sort(np.concatenate([np.arange(k), r.integers(0, k, r.integers(0, 30))]))
        t = r.integers(0, 60, len(codes))
        t, w = t[np.lexsort((t, codes))], int(r.integers(0, 15))
        start, count = np.where(r.random(k) < .5, r.integers(-20, 50, k), NO_WINDOW), r.integers(1, 9, k)
        starts, counts = fold_keys(codes, t, start, count, w)
        for i in range(k):
            none = start[i] == NO_WINDOW
            want = fold_times(t[codes == i], None if none else int(start[i]), 0 if none else int(count[i]), w)
            assert starts[codes == i].tolist() == want[0].tolist() and counts[codes == i].tolist() == want[1].tolist()


def test_a_bucket_of_signatures_is_one_call_and_equals_a_call_each():
    class State:
        hasTimedOut, value = False, None  # noqa: N815
        exists = property(lambda self: self.value is not None)
        get = property(lambda self: self.value)

        def getCurrentWatermarkMs(self):  # noqa: N802
            return 0

        def update(self, v):
            self.value = v

        def setTimeoutTimestamp(self, ms):  # noqa: N802
            self.timeout = ms

    r = np.random.default_rng(2)
    n = 400
    rows = pd.DataFrame({
        "id": [str(i) for i in range(n)], "session_name": "s", "signature": r.choice(["a", "b", "c", None], n),
        "timestamp": pd.to_datetime(np.sort(r.integers(0, 5000, n)), unit="s"), "pane_id": "p", "sequence": range(n),
        "severity": "INFO", "sev_rank": 2})
    fold = _pattern_fold(60_000_000, 900_000_000)

    def run(parts):
        state = State()
        return pd.concat([o for p in parts for o in fold(("s", 0), iter([p]), state)]).set_index("id")

    batches = [rows[:150], rows[150:300], rows[300:]]
    together = run(batches)
    apart = pd.concat([run([b[b["signature"].isna() if k is None else b["signature"] == k] for b in batches]) for k in ("a", "b", "c", None)])
    columns = ["window_start", "window_count", "occurrence_count", "is_first"]
    pd.testing.assert_frame_equal(together[columns].sort_index(), apart[columns].sort_index())


def test_a_bucket_of_alert_keys_is_one_call_and_equals_a_call_each():
    r = np.random.default_rng(3)
    n = 300
    lines = pd.DataFrame({"key": r.choice(["a", "b", "c"], n), "kind": "line", "alert_type": None, "at": np.sort(r.integers(0, 10**9, n)),
                          "pane_id": "p", "sequence": range(n), "severity": "ERROR", "sev_rank": 4})
    acts = pd.DataFrame({"key": ["a", "b"], "kind": ["acknowledge", "resolve"], "alert_type": "RecurringError", "at": [4 * 10**8, 5 * 10**8]})
    rows = pd.concat([lines, acts])

    def run(part):
        p = started(SA.AlertProcessor(SA.Rules(recurring=3)))
        out = [v for lo, hi in ((0, 3 * 10**8), (3 * 10**8, 10**9))
               for v in p.handleInputRows(("s", "pattern", 0), iter([part[(part["at"] >= lo) & (part["at"] < hi)]]), None)]
        return pd.concat(out).sort_values(["id", "version"]).reset_index(drop=True)

    apart = pd.concat([run(rows[rows["key"] == k]) for k in "abc"]).sort_values(["id", "version"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(run(rows), apart)


def test_many_entries_of_a_pane_in_one_call():
    n = 60_000
    at = np.arange(n, dtype=np.int64) * 1000
    rows = pd.DataFrame({"id": np.arange(n).astype(str), "sequence": np.arange(n), "raw_content": "x", "is_start": np.arange(n) % 3 != 1,
                         "ts_us": at, "received_us": at})
    before = time.monotonic()
    out = pd.concat(started(CollapseProcessor(10**9)).handleInputRows(("s", "p"), iter([rows]), None))
    assert time.monotonic() - before < 6  # tables cut out an entry took about 0.3 ms each
    assert len(out) == 2 * n // 3 - 1 and out["line_count"].sum() == n - 1 and out["content"].iloc[0] == "x\nx"


def test_stretches_have_the_same_number_of_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 12)
    df = spark.createDataFrame([(i, day) for i in range(100)], "i long, at timestamp")
    path, files = S.write_parts(df, "at", str(tmp_path / "parts"), 1, rows=30)
    assert files == 4 and len(list((tmp_path / "parts").glob("part-*.parquet"))) == 3 * files
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
    seen = {}
    q = stream.writeStream.foreachBatch(lambda b, n: seen.update({n: b.count()})).option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == {0: 0, 1: 100, 2: 0}
