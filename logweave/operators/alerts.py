"""Alerts (K1-K7): trigger rows -> one alert per dedup key and episode.

Dedup (K5): at most one Active alert per (session, type, pattern); repeats
only update ``current_value``.  Without actions an alert stays Active, so an
alert is an aggregate over its trigger rows: first trigger = triggered_at
(and message), last trigger = current value.  With an ``alert_actions``
table (K6) an acknowledge/resolve closes the episode and the next trigger
opens a new alert; the episode number of a trigger is the count of actions
before it, looked up in the per-key action list (actions are few, triggers
many, so no range join and no per-key window over the triggers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import RANK
from .patterns import level_of
from .sequence import join_keys

# --- fixed values: alert types and message texts ----------------------------
RECURRING = "RecurringError"
RESTART_LOOP = "RestartLoop"
NEW_EXCEPTION = "NewException"
ERROR_RATE = "ErrorRate"
NEW_EXCEPTION_SIGNATURE_CHARS = 20
# ----------------------------------------------------------------------------

ALERT_COLUMNS = ["id", "session_name", "alert_type", "incident_id", "pattern_id", "threshold",
                 "current_value", "triggered_at", "acknowledged_at", "status", "message", "severity"]

_ORDER = ["timestamp", "pane_id", "sequence"]


def window_label(width_s: int) -> str:
    return {60: "60s", 3600: "1h", 86400: "1d"}.get(int(width_s), f"{int(width_s)}s")


def _episodes(trig: DataFrame, actions: DataFrame | None) -> DataFrame:
    if actions is None:
        return trig.withColumn("_episode", F.lit(0))
    acts = actions.groupBy("session_name", "alert_type", F.col("key").alias("_key")).agg(
        F.array_sort(F.collect_list("at")).alias("_acts"))
    t = trig.join(acts, ["session_name", "alert_type", "_key"], "left")
    before = F.size(F.filter(F.coalesce(F.col("_acts"), F.array().cast("array<timestamp>")),
                             lambda a: a <= F.col("timestamp")))
    return t.withColumn("_episode", before).drop("_acts")


def _status(alerts: DataFrame, actions: DataFrame | None) -> DataFrame:
    if actions is None:
        return (alerts.withColumn("status", F.lit("Active"))
                .withColumn("acknowledged_at", F.lit(None).cast("timestamp")))
    # the actions of an alert: from its opening to the next alert of the key
    acts = actions.select(F.col("session_name").alias("_s"), F.col("alert_type").alias("_ty"),
                          F.col("key").alias("_k"), "action", "at")
    cond = ((F.col("session_name") == F.col("_s")) & (F.col("alert_type") == F.col("_ty"))
            & (F.col("_key") == F.col("_k")) & (F.col("at") >= F.col("triggered_at"))
            & (F.col("_next_open").isNull() | (F.col("at") < F.col("_next_open"))))
    j = alerts.join(acts, cond, "left")
    g = j.groupBy(*alerts.columns).agg(
        F.min(F.when(F.col("action") == "resolve", F.col("at"))).alias("_resolved"),
        F.min(F.when(F.col("action") == "acknowledge", F.col("at"))).alias("_ack"))
    acked = F.col("_ack").isNotNull() & (F.col("_resolved").isNull() | (F.col("_ack") < F.col("_resolved")))
    status = (F.when(F.col("_resolved").isNotNull(), F.lit("Resolved"))
              .when(acked, F.lit("Acknowledged")).otherwise(F.lit("Active")))
    return (g.withColumn("status", status)
            .withColumn("acknowledged_at", F.when(acked, F.col("_ack")))
            .drop("_resolved", "_ack"))


def dedup_alerts(trig: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """K5/K6: trigger rows (session_name, alert_type, _key, timestamp, pane_id,
    sequence, value, message, severity, pattern_id, threshold) -> alerts."""
    t = _episodes(trig, actions)
    order = F.struct(*[F.col(c) for c in _ORDER])
    g = t.groupBy("session_name", "alert_type", "_key", "_episode").agg(
        F.min_by(F.struct("timestamp", "message", "severity", "pattern_id", "threshold"), order).alias("_f"),
        F.max_by("value", order).alias("current_value"),
        F.count(F.lit(1)).alias("trigger_count"))
    a = g.select("session_name", "alert_type", "_key", "_episode",
                 F.col("_f.timestamp").alias("triggered_at"), F.col("_f.message").alias("message"),
                 F.col("_f.severity").alias("severity"), F.col("_f.pattern_id").alias("pattern_id"),
                 F.col("_f.threshold").alias("threshold"), "current_value", "trigger_count")
    if actions is not None:
        # per key the few episodes; the next alert of a key opens at the
        # earliest first trigger of a later episode
        opens = a.groupBy("session_name", "alert_type", "_key").agg(
            F.collect_list(F.struct(F.col("_episode").alias("e"), F.col("triggered_at").alias("t")))
            .alias("_opens"))
        a = a.join(opens, ["session_name", "alert_type", "_key"]).withColumn(
            "_next_open", F.array_min(F.transform(
                F.filter("_opens", lambda o: o["e"] > F.col("_episode")), lambda o: o["t"]))).drop("_opens")
    else:
        a = a.withColumn("_next_open", F.lit(None).cast("timestamp"))
    a = _status(a, actions)
    return a.select(
        F.md5(F.concat_ws("|", "session_name", "alert_type", "_key",
                          F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias("id"),
        "session_name", "alert_type", F.lit(None).cast("string").alias("incident_id"), "pattern_id",
        "threshold", "current_value", "triggered_at", "acknowledged_at", "status", "message", "severity",
        "trigger_count")


def _trig(df: DataFrame, alert_type: str, key: Column, value: Column, message: Column,
          severity: Column, pattern_id: Column, threshold: Column) -> DataFrame:
    return df.select("session_name", F.lit(alert_type).alias("alert_type"), key.alias("_key"),
                     *_ORDER, value.cast("double").alias("value"), message.alias("message"),
                     severity.alias("severity"), pattern_id.alias("pattern_id"),
                     threshold.cast("double").alias("threshold"))


def recurring_triggers(windows: DataFrame, width_s: int, threshold: int, key: str = "signature") -> DataFrame:
    """K2: rows whose pattern window count reached ``threshold``; severity is
    the pattern's highest severity up to the first such row.

    One aggregate finds, a pattern, the first such occurrence and the first
    occurrence of each level; the highest level not after it is the severity."""
    hit = F.col("window_count") >= threshold
    levels = sorted(RANK.values())
    first = (windows.groupBy("session_name", key).agg(
        F.min(F.when(hit, F.col("occurrence"))).alias("_hit"),
        *[F.min(F.when(F.col("sev_rank") == r, F.col("occurrence"))).alias(f"_at{r}") for r in levels])
        .where("_hit IS NOT NULL"))
    upto = F.greatest(*[F.when(F.col(f"_at{r}") <= F.col("_hit"), F.lit(r)) for r in levels])
    h = join_keys(windows.where(hit), first.select("session_name", key, upto.alias("_r")), ["session_name", key])
    msg = F.concat(F.lit("Recurring error: "), F.col("window_count").cast("string"),
                   F.lit(f" occurrences in {window_label(width_s)}"))
    return _trig(h, RECURRING, F.col(key), F.col("window_count"), msg, level_of(F.col("_r")),
                 F.col(key), F.lit(threshold))


def new_exception_triggers(windows: DataFrame, key: str = "signature") -> DataFrame:
    """K3: the first entry of a pattern with rank >= ERROR (UNKNOWN included)."""
    f = windows.where((F.col("occurrence") == 1) & (F.col("sev_rank") >= RANK["ERROR"]))
    msg = F.concat(F.lit("New unseen exception: "), F.substring(F.col(key), 1, NEW_EXCEPTION_SIGNATURE_CHARS))
    return _trig(f, NEW_EXCEPTION, F.col(key), F.lit(1.0), msg, F.col("severity"), F.col(key),
                 F.lit(None))


def error_rate_triggers(rates: DataFrame, width_s: int, threshold: float,
                        rate_key: str | None = "_global") -> DataFrame:
    """K1: error-rate rows at or over ``threshold``; one dedup key per session
    (the rate of ``rate_key`` is checked, ``None`` checks every key)."""
    r = rates.where(F.col("rate") >= threshold)
    if rate_key is not None:
        r = r.where(F.col("rate_key") == rate_key)
    msg = F.concat(F.lit("Error rate "), F.format_string("%.1f", F.col("rate").cast("double")),
                   F.lit(f"/{window_label(width_s)} exceeds threshold"))
    return _trig(r, ERROR_RATE, F.lit(""), F.col("rate"), msg, F.lit("WARN"),
                 F.lit(None).cast("string"), F.lit(threshold))


def restart_loop_triggers(restart_windows_df: DataFrame, min_transitions: int = 2) -> DataFrame:
    """K4: a service entering a restart loop (one alert per session and service)."""
    r = restart_windows_df.where(F.col("window_count") >= min_transitions)
    msg = F.concat(F.lit("Service restart loop detected: "), F.col("restart_service"))
    return _trig(r, RESTART_LOOP, F.col("restart_service"), F.lit(1.0), msg, F.lit("ERROR"),
                 F.lit(None).cast("string"), F.lit(None))
