"""Panes on a stream (P16, L4, W8): keyed state with event-time timers.

* ``collapse_stream``: the open entry of a pane takes continuation lines; it closes on the next
  start line or after ``silence_s`` without a line, by a timer where none comes.
* ``liveness_events``: a pane turns Active with a line, Stale and Disconnected after their silences;
  silences between lines of a micro-batch give their events at once, a silence that lasts by timers.
* ``cycle_stream``: the strict restart cycle over a service's last transitions.

Lines of a pane inside one micro-batch are taken by arrival; the watermark stands on ``received_at``.
Timers that a later line has overtaken find that on expiry and do nothing.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.multiline import CONTINUATION
from ..operators.windows import transitions
from .alerts import ROCKSDB, STORE

PANE = ["session_name", "pane_id"]
ENTRY = ("session_name string, pane_id string, group_start long, id string, timestamp timestamp, line_count long, "
         "last_sequence long, content string")
EVENT = "session_name string, pane_id string, status string, at timestamp"
CYCLE = "session_name string, restart_service string, cycle_start timestamp, cycle_end timestamp, id string"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def moment(us: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(us))


def timer_ms(us: int) -> int:
    """The first whole millisecond after a moment."""
    return us // 1000 + 1


class _Keyed(StatefulProcessor):
    """State as one JSON text a key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "body string")

    def load(self) -> dict | None:
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def save(self, body: dict) -> None:
        self.state.update((json.dumps(body),))

    def close(self) -> None:
        pass


class CollapseProcessor(_Keyed):
    def __init__(self, silence_us: int):
        self.silence = silence_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["received_us", "sequence", "raw_content"], kind="stable", ignore_index=True)
        open_ = self.load()
        t = pdf["received_us"].to_numpy(dtype=np.int64)
        before = np.concatenate([[open_["last"] if open_ else t[0] - self.silence - 1], t[:-1]])
        begins = pdf["is_start"].to_numpy(dtype=bool) | (t - before > self.silence)
        # the places where entries begin; a part before the first belongs to the open entry
        cuts = np.flatnonzero(begins)
        if open_ is not None and (not len(cuts) or cuts[0]):
            cuts = np.concatenate([[0], cuts])
        ends = np.append(cuts[1:], len(t))
        first_ts = np.minimum.reduceat(pdf["ts_us"].to_numpy(dtype=np.int64), cuts).tolist()
        sequence, ids, lines = pdf["sequence"].tolist(), pdf["id"].tolist(), pdf["raw_content"].tolist()
        done = []
        for i, j, ts in zip(cuts.tolist(), ends.tolist(), first_ts):
            if begins[i] or open_ is None:
                if open_ is not None:
                    done.append(open_)
                open_ = {"group_start": sequence[i], "id": ids[i], "ts": ts, "n": 0, "lines": []}
            open_["ts"] = min(open_["ts"], ts)
            open_["n"] += j - i
            open_["last_sequence"] = sequence[j - 1]
            open_["lines"] += lines[i:j]
        open_["last"] = int(t[-1])
        self.save(open_)
        self.handle.registerTimer(timer_ms(open_["last"] + self.silence))
        if done:
            yield self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_ = self.load()
        if open_ is not None and timer_ms(open_["last"] + self.silence) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._rows(key, [open_])

    @staticmethod
    def _rows(key, done):
        return pd.DataFrame([(*key, e["group_start"], e["id"], moment(e["ts"]), e["n"], e["last_sequence"], "\n".join(e["lines"]))
                             for e in done], columns=names(ENTRY))


class LivenessProcessor(_Keyed):
    """State: the last line and how many of the two silences were already told."""

    def __init__(self, stale_us: int, gone_us: int):
        self.waits = [("Stale", stale_us), ("Disconnected", gone_us)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = np.sort(pd.concat(list(rows), ignore_index=True)["received_us"].to_numpy(dtype=np.int64))
        body = self.load()
        told = body["told"] if body else 0
        out = [] if body else [("Active", int(t[0]))]
        every = np.concatenate([[body["last"]], t]) if body else t
        for i in np.flatnonzero(np.diff(every) > self.waits[0][1]).tolist():
            last, nxt = int(every[i]), int(every[i + 1])
            out += [(s, last + w) for s, w in self.waits[told if body and i == 0 else 0:] if nxt - last > w]
            out.append(("Active", nxt))
        if body and every[-1] == body["last"]:
            self.save(body)
        else:
            self.save({"last": int(every[-1]), "told": 0})
            self.handle.registerTimer(timer_ms(int(every[-1]) + self.waits[0][1]))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        body = self.load()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out = []
        while body is not None and body["told"] < len(self.waits):
            status, wait = self.waits[body["told"]]
            if timer_ms(body["last"] + wait) > now:
                if out:  # otherwise a later line has its own timer
                    self.handle.registerTimer(timer_ms(body["last"] + wait))
                break
            out.append((status, body["last"] + wait))
            body["told"] += 1
        if out:
            self.save(body)
            yield self._rows(key, out)

    @staticmethod
    def _rows(key, events):
        return pd.DataFrame([(*key, s, moment(us)) for s, us in events], columns=names(EVENT))


class CycleProcessor(_Keyed):
    STEPS = ["Starting", "Running", "Stopping", "Starting"]

    def __init__(self, width_us: int):
        self.width = width_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(["ts_us", "pane_id", "sequence"], kind="stable")
        tail = (self.load() or {"tail": []})["tail"]
        states = [s for s, _ in tail] + pdf["state"].tolist()
        times = [t for _, t in tail] + pdf["ts_us"].tolist()
        ids = [None] * len(tail) + pdf["id"].tolist()
        hits = [i for i in range(3, len(states)) if ids[i] is not None and states[i - 3:i + 1] == self.STEPS
                and times[i] - times[i - 3] <= self.width]
        self.save({"tail": [[s, int(t)] for s, t in zip(states[-3:], times[-3:])]})
        if hits:
            yield pd.DataFrame([(*key, moment(times[i - 3]), moment(times[i]), ids[i]) for i in hits], columns=names(CYCLE))


def _with_store(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get(STORE, "") != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)
    return df


def collapse_stream(entries: DataFrame, silence_s: int, starts: Column | None = None) -> DataFrame:
    """P16 on a stream of entries with a watermark on ``received_at``."""
    is_start = starts if starts is not None else ~F.col("raw_content").rlike(CONTINUATION)
    rows = entries.select(*PANE, "id", "sequence", "raw_content", is_start.alias("is_start"),
                          F.unix_micros("timestamp").alias("ts_us"), F.unix_micros("received_at").alias("received_us"), "received_at")
    return _with_store(rows).groupBy(*PANE).transformWithStateInPandas(
        CollapseProcessor(silence_s * 1_000_000), ENTRY, "Append", "EventTime")


def liveness_events(entries: DataFrame, stale_after_s: int, disconnect_after_s: int) -> DataFrame:
    """L4 on a stream of entries with a watermark on ``received_at``."""
    rows = entries.select(*PANE, F.unix_micros("received_at").alias("received_us"), "received_at")
    return _with_store(rows).groupBy(*PANE).transformWithStateInPandas(
        LivenessProcessor(stale_after_s * 1_000_000, disconnect_after_s * 1_000_000), EVENT, "Append", "EventTime")


def cycle_stream(entries: DataFrame, width_s: int) -> DataFrame:
    """W8 on a stream of entries."""
    rows = transitions(entries).select("session_name", "restart_service", "id", "pane_id", "sequence", "state",
                                       F.unix_micros("timestamp").alias("ts_us"))
    return _with_store(rows).groupBy("session_name", "restart_service").transformWithStateInPandas(
        CycleProcessor(width_s * 1_000_000), CYCLE, "Append", "None")
