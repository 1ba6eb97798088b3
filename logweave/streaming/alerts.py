"""Alerts on a stream (K1-K6, K8): one keyed state for triggers, dedup and actions.

Entries and the actions of people come in as two streams and are dealt by (session, family) and a bucket of keys:
``pattern`` (key: signature; recurring errors and new exceptions), ``rate`` (errors
without a service) and ``restart`` (key: service).  ``transformWithState`` keeps for each
key the open anchored window or the error times of the last ``rate_width``, and for each alert
type its latest alert; the keys of a bucket share one state and one call.  A trigger updates that alert; after an acknowledge or resolve the
next trigger opens another one.  Every micro-batch emits a version of each alert it
changed; ``latest_by_id`` over the versions is the alert table, equal to the batch
``dedup_alerts`` when lines and actions arrive in event order across micro-batches (inside
one they are sorted).  The lines of a bucket are sorted at once; work a key is on slices of its arrays, Python
steps are a few a key and an action.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.severity import LEVELS, RANK
from ..functions.text import exact_signature
from ..operators import alerts as K
from ..operators.fold import fold_times
from ..operators.windows import UNKNOWN_SERVICE, service_state
from ..sources.sinks import latest_by_id

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAMILY = {K.RECURRING: "pattern", K.NEW_EXCEPTION: "pattern", K.ERROR_RATE: "rate", K.RESTART_LOOP: "restart"}
VERSIONS = ("id string, session_name string, alert_type string, key string, pattern_id string, threshold double, "
            "current_value double, triggered_at timestamp, acknowledged_at timestamp, status string, message string, "
            "severity string, trigger_count long, version long")
COLUMNS = [c.split()[0] for c in VERSIONS.split(", ")]
#: Buckets of keys of a session and family that share a state; fixed for the life of a checkpoint.
BUCKETS = 256


@dataclass(frozen=True)
class Rules:
    """Widths in seconds and thresholds of the four alert types."""
    pattern_width: int = 60
    recurring: int = 5
    rate_width: int = 60
    rate: float = 10.0
    restart_width: int = 30
    transitions: int = 2


def observations(entries: DataFrame, actions: DataFrame) -> DataFrame:
    """(session_name, family, key, kind, at, ...) of entries and of ``actions``
    (session_name, alert_type, key, action, at)."""
    def seen(when, family, key):
        return F.when(when, F.struct(F.lit(family).alias("family"), key.alias("key")))

    e = entries.withColumns({"_sig": exact_signature(F.col("raw_content")), "_state": service_state(F.col("raw_content"))})
    kinds = F.array_compact(F.array(
        seen(F.lit(True), "pattern", F.col("_sig")),
        seen((F.col("sev_rank") >= RANK["ERROR"]) & F.col("service").isNull(), "rate", F.lit("")),
        seen(F.col("_state").isNotNull(), "restart", F.coalesce("service", F.lit(UNKNOWN_SERVICE)))))
    lines = e.select("session_name", F.explode(kinds).alias("_k"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("alert_type"),
                     F.unix_micros("timestamp").alias("at"), "pane_id", "sequence", "severity", "sev_rank").select(
        "session_name", "_k.family", "_k.key", "kind", "alert_type", "at", "pane_id", "sequence", "severity", "sev_rank")
    family = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])[F.col("alert_type")]
    acts = actions.select("session_name", family.alias("family"), "key", F.col("action").alias("kind"), "alert_type",
                          F.unix_micros("at").alias("at"), F.lit(None).cast("string").alias("pane_id"),
                          F.lit(None).cast("long").alias("sequence"), F.lit(None).cast("string").alias("severity"),
                          F.lit(None).cast("int").alias("sev_rank"))
    return lines.unionByName(acts)


@dataclass
class Triggers:
    """Triggers of one type in time order: times, values, and what an alert opened by number i says."""
    times: np.ndarray
    values: np.ndarray
    say: object  # i -> (message, severity)


class Track:
    """The latest alert of one (session, type, key), from and to its state."""

    def __init__(self, body: dict | None):
        self.alert = (body or {}).get("alert")
        self.closed = (body or {}).get("closed", False)
        self.changed: dict[int, dict] = {}

    def body(self) -> dict:
        return {"alert": self.alert, "closed": self.closed}

    def trigger(self, t: Triggers, i: int, j: int) -> None:
        if i == j:
            return
        if self.alert is None or self.closed:
            message, severity = t.say(i)
            self.alert = {"at": int(t.times[i]), "message": message, "severity": severity, "count": 0, "ack": None, "done": None}
            self.closed = False
        self.alert["count"] += j - i
        self.alert["value"] = float(t.values[j - 1])
        self.changed[self.alert["at"]] = self.alert

    def act(self, name: str, at: int) -> None:
        if self.alert is not None:
            slot = {"acknowledge": "ack", "resolve": "done"}[name]
            self.alert[slot] = at if self.alert[slot] is None else min(at, self.alert[slot])
            self.changed[self.alert["at"]] = self.alert
            self.closed = True

    def advance(self, t: Triggers, actions: list[tuple[int, str]]) -> None:
        """An action ends the episode for triggers at or after it; it belongs to the
        alert last opened at or before it."""
        i = 0
        for at in sorted({a for a, _ in actions}):
            j = int(np.searchsorted(t.times, at, side="left"))
            self.trigger(t, i, j)
            i = int(np.searchsorted(t.times, at, side="right"))
            if i > j:  # triggers of the same moment open the next alert first
                self.closed = True
                self.trigger(t, j, i)
            for a, name in sorted(actions):
                if a == at:
                    self.act(name, at)
            if i > j:  # that alert's triggers came with the action, not before it
                self.closed = False
        self.trigger(t, i, len(t.times))


@dataclass
class Lines:
    """The lines of one key in order."""
    t: np.ndarray
    rank: np.ndarray
    level: np.ndarray


NO_ROWS = np.empty(0, dtype=np.int64)
NO_LINES = Lines(NO_ROWS, NO_ROWS, NO_ROWS)


def _slices(lines: pd.DataFrame) -> dict[str | None, Lines]:
    """The lines of every key, from one sort."""
    place, names = pd.factorize(lines["key"].to_numpy(dtype=object), use_na_sentinel=False)
    lines = lines.assign(_key=place).sort_values(["_key", "at", "pane_id", "sequence"], kind="stable")
    t, rank = lines["at"].to_numpy(dtype=np.int64), lines["sev_rank"].to_numpy(dtype=np.int64)
    level = lines["severity"].to_numpy(dtype=object)
    cuts = np.searchsorted(lines["_key"].to_numpy(), np.arange(len(names) + 1)).tolist()
    return {None if pd.isna(k) else k: Lines(t[i:j], rank[i:j], level[i:j]) for k, i, j in zip(names, cuts, cuts[1:])}


class AlertProcessor(StatefulProcessor):
    """State of a bucket: a JSON list of (key, its alerts, window and times)."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("alerts", "body string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        session, family, _ = key
        pdf = pd.concat(list(rows), ignore_index=True)
        is_line = (pdf["kind"] == "line").to_numpy()
        lines = _slices(pdf[is_line])
        acts: dict[str | None, list] = {}
        for name, kind, at, action in pdf.loc[~is_line, ["key", "alert_type", "at", "kind"]].itertuples(index=False, name=None):
            acts.setdefault(None if pd.isna(name) else name, []).append((kind, int(at), action))
        bodies = {k: body for k, body in json.loads(self.state.get()[0])} if self.state.exists() else {}
        out = []
        for name in {**lines, **acts}:
            body = bodies.setdefault(name, {})
            mine = acts.get(name, [])
            found = getattr(self, f"_{family}")(lines.get(name, NO_LINES), body, name)
            version = body.get("version", 0) + 1
            for kind, t in found.items():
                track = Track(body.get(kind))
                track.advance(t, [(at, action) for k, at, action in mine if k == kind])
                if track.alert is not None or track.closed:
                    body[kind] = track.body()
                out += [self._row(session, kind, name, a, version) for a in track.changed.values()]
            body["version"] = version
        self.state.update((json.dumps(list(bodies.items()), separators=(",", ":")),))
        if out:
            yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass

    def _row(self, session, kind, name, a, version):
        def moment(us):
            return None if us is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=us)

        opened = moment(a["at"]).strftime("%Y-%m-%d %H:%M:%S.%f")
        digest = hashlib.md5("|".join(x for x in (session, kind, name, opened) if x is not None).encode()).hexdigest()
        acked = a["ack"] is not None and (a["done"] is None or a["ack"] < a["done"])
        status = "Resolved" if a["done"] is not None else "Acknowledged" if acked else "Active"
        r = self.rules
        threshold = {K.RECURRING: float(r.recurring), K.ERROR_RATE: float(r.rate)}.get(kind)
        return (digest, session, kind, name, name if FAMILY[kind] == "pattern" else None, threshold, a["value"], moment(a["at"]),
                moment(a["ack"]) if acked else None, status, a["message"], a["severity"], a["count"], version)

    def _windows(self, t, body, width):
        starts, counts, start, count = fold_times(t, body.get("start"), body.get("count", 0), width * 1_000_000)
        body.update(start=start if start is None else int(start), count=int(count))
        return counts

    def _pattern(self, lines, body, name):
        r = self.rules
        t, rank = lines.t, lines.rank
        new = Triggers(NO_ROWS, NO_ROWS, None)
        if len(t) and not body.get("known"):
            if rank[0] >= RANK["ERROR"]:
                new = Triggers(t[:1], np.ones(1), lambda i: (
                    None if name is None else f"New unseen exception: {name[:K.NEW_EXCEPTION_SIGNATURE_CHARS]}", lines.level[0]))
            body["known"] = True
        counts = self._windows(t, body, r.pattern_width)
        hit = np.flatnonzero(counts >= r.recurring)
        if body.get("level") is None and len(t):  # the highest level up to the first recurring line
            upto = len(t) if not len(hit) else hit[0] + 1
            body["highest"] = max(body.get("highest", -1), int(rank[:upto].max()))
            if len(hit):
                body["level"] = LEVELS[body["highest"]]
        label = K.window_label(r.pattern_width)
        again = Triggers(t[hit], counts[hit], lambda i: (f"Recurring error: {counts[hit][i]} occurrences in {label}", body["level"]))
        return {K.NEW_EXCEPTION: new, K.RECURRING: again}

    def _rate(self, lines, body, name):
        r = self.rules
        t, width = lines.t, r.rate_width * 1_000_000
        every = np.sort(np.concatenate([np.array(body.get("times", []), dtype=np.int64), t]), kind="stable")
        counts = np.searchsorted(every, t, side="right") - np.searchsorted(every, t - width, side="left")
        hit = np.flatnonzero(counts >= r.rate)
        body["times"] = every[np.searchsorted(every, every[-1] - width, side="left"):].tolist() if len(every) else []
        label = K.window_label(r.rate_width)
        return {K.ERROR_RATE: Triggers(t[hit], counts[hit], lambda i: (
            f"Error rate {float(counts[hit][i]):.1f}/{label} exceeds threshold", "WARN"))}

    def _restart(self, lines, body, name):
        t = lines.t
        hit = np.flatnonzero(self._windows(t, body, self.rules.restart_width) >= self.rules.transitions)
        return {K.RESTART_LOOP: Triggers(t[hit], np.ones(len(hit)), lambda i: (
            f"Service restart loop detected: {name}", "ERROR"))}


def alert_versions(entries: DataFrame, actions: DataFrame, rules: Rules) -> DataFrame:
    """The stream of alert versions; its state needs the RocksDB store."""
    spark = entries.sparkSession
    if spark.conf.get(STORE, "") != ROCKSDB:
        spark.conf.set(STORE, ROCKSDB)
    seen = observations(entries, actions).withColumn("_bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return (seen.groupBy("session_name", "family", "_bucket")
            .transformWithStateInPandas(AlertProcessor(rules), VERSIONS, "Append", "None"))


def alert_table(versions: DataFrame) -> DataFrame:
    """The latest version of every alert (K8 as a table)."""
    return latest_by_id(versions, "id", "version")
