"""Named queries over the test tables: ``name -> (spark, sf_dir) -> DataFrame``.

Every query starts from the given tables (``events`` rendered into log
lines, ``documents``, ``conversations``) and runs over all of their rows.
Parameters follow FIXTURES.md part C (the events span one month, so the
windows are a day wide) and ``AS_OF`` replaces the wall clock.  Array and
map columns are rendered as text here so results can be compared.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import fields_text, parse_entries
from ..functions.severity import classify_keywords
from ..functions.text import mask_addresses, normalize_full, normalize_signature
from ..operators import aggregates as A
from ..operators import cluster as Cl
from ..operators import alerts as K
from ..operators import filters as Fl
from ..operators import incidents as I
from ..operators import lifecycle as L
from ..operators import patterns as Pt
from ..operators import windows as W
from ..operators.sequence import join_keys
from ..sources.fixtures import log_lines, restarted_lines
from ..sources.sinks import durable_rows

# --- query parameters (FIXTURES.md part C) ----------------------------------
AS_OF = dt.datetime(2024, 1, 31, 0, 0, 0)
PATTERN_WINDOW_S = 86400
RECURRING_THRESHOLD = 5
RESTART_WINDOW_S = 6 * 3600
RATE_WINDOW_S = 86400
RATE_THRESHOLD = 5
STALE_AFTER_S = 3600
DISCONNECT_AFTER_S = 6 * 3600
SEARCH_NEEDLE = "refused"
FILTER_REGEX = "refused|segfault"
CONTEXT_LINES = 2
PAGE_SINCE = dt.datetime(2024, 1, 10)
PAGE_UNTIL = dt.datetime(2024, 1, 20, 23, 59, 59)
PAGE_SEVERITY = "error"
PAGE_OFFSET = 20
PAGE_LIMIT = 100
SINCE = dt.datetime(2024, 1, 29)
DURABLE_SINCE = dt.datetime(2024, 1, 15)
RING_CAPACITY = 100
BUFFER_CAPACITY = 500
RETENTION_S = 86400
TOP_K = 10
SPIKE_WINDOW = "1 day"
SUMMARY_START = dt.datetime(2024, 1, 24)
DIGEST_SINCE = dt.datetime(2024, 1, 28)
DIGEST_LEVEL = "ERROR"
TOKEN_BUDGET = 1000
# user patterns for four of the fixture's layouts
CUSTOM_PATTERNS = [
    r'^\{"timestamp":"(?P<timestamp>[^"]+)","level":"(?P<level>[a-z]+)","service":"(?P<service>[^"]+)"',
    r'^ts=(?P<timestamp>\S+) level=(?P<level>[a-z]+) service=(?P<service>\S+) msg="(?P<message>[^"]*)"',
    r"^(?P<timestamp>\S+) \[(?P<service>[\w-]+)\] (?P<level>\w+): (?P<message>.*)$",
    r"^(?P<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (?P<level>\w+) service=(?P<service>\S+) "
    r"(?P<message>.*)$",
]
# a line starting with a time, a JSON object or a key=value pair starts an entry
MULTILINE_START = r"^(\d{4}-\d{2}-\d{2}|[A-Z][a-z]{2}\s+\d|\{|\w+=)"
SPIKE_MIN_ERRORS = 10
PATTERN_SPIKE = 20
CLUSTER_LIMIT = 50
FILTER_LIMIT = 500
FILTER_PANE = "pane-3"
AFFECTED_SERVICE = "svc-1"
AUTO_RESOLVE_S = 14 * 86400
LOOP_AS_OF = dt.datetime(2024, 1, 28, 12, 0, 0)
RECURRING_AFTER_S = 300
RESOLVED_AFTER_S = 600
CYCLE_WINDOW_S = 4 * 86400
STALE_SESSION_S = 5 * 86400
LEADER_TTL_S = 6 * 3600
CONTEXT_BUDGET = 4000
DOCUMENT_LIMIT = 50
# ----------------------------------------------------------------------------

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removesuffix("_q")] = fn
    return fn


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_entries(log_lines(spark, sf_dir))


def parsed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries as a table, for queries that read them several times."""
    from ..session import materialize
    return materialize(entries(spark, sf_dir).drop("parsed_fields"))


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pt.with_signature(entries(spark, sf_dir))


# ---- step 1: parse ----------------------------------------------------------

@query
def parse_entries_q(spark, sf_dir):
    return entries(spark, sf_dir).drop("parsed_fields")


@query
def parse_kv_fields(spark, sf_dir):
    return entries(spark, sf_dir).select("id", fields_text(F.col("parsed_fields")).alias("fields"))


@query
def severity_distribution(spark, sf_dir):
    return A.severity_distribution(entries(spark, sf_dir), ("session_name", "service"))


# ---- step 2: filters --------------------------------------------------------

@query
def classify_severity(spark, sf_dir):
    return entries(spark, sf_dir).select("id", classify_keywords(F.col("raw_content")).alias("keyword_severity"))


@query
def line_filter(spark, sf_dir):
    return Fl.line_filter(parse_entries(Fl.matching_lines(log_lines(spark, sf_dir), "ERROR")), "ERROR").select(
        "id", "pane_id", "sequence", "detected_severity")


@query
def line_filter_regex(spark, sf_dir):
    found = Fl.matching_lines(log_lines(spark, sf_dir), "ERROR", FILTER_REGEX)
    return Fl.line_filter(parse_entries(found), "ERROR", FILTER_REGEX).select(
        "id", "pane_id", "sequence", "detected_severity")


@query
def first_matches(spark, sf_dir):
    """F2 with a limit: the first matching lines in pane order."""
    found = Fl.matching_lines(log_lines(spark, sf_dir), "ERROR")
    return Fl.line_filter(parse_entries(found), "ERROR", limit=FILTER_LIMIT).select(
        "id", "pane_id", "sequence", "detected_severity")


@query
def pane_level(spark, sf_dir):
    """one level of one pane."""
    return Fl.by_pane(Fl.by_severity(entries(spark, sf_dir), "ERROR"), FILTER_PANE).select(
        "id", "session_name", "sequence", "timestamp")


@query
def severe_services(spark, sf_dir):
    """F10, A5 and the sorted form of A3."""
    e = Fl.severe_only(entries(spark, sf_dir)).select("session_name", "severity", "service")
    services = A.service_set(e).select("session_name", F.array_join("services", ",").alias("services"))
    return A.error_counts(e).join(services, "session_name", "left")


@query
def context_lines(spark, sf_dir):
    e = entries(spark, sf_dir)
    match = classify_keywords(F.col("raw_content")) == "FATAL"
    return Fl.context_lines(e, match, CONTEXT_LINES).select(
        "id", "pane_id", "sequence", "is_match", "matches_near")


@query
def search_text(spark, sf_dir):
    return Fl.search_text(parse_entries(Fl.lines_with(log_lines(spark, sf_dir), SEARCH_NEEDLE)), SEARCH_NEEDLE)


@query
def entries_page(spark, sf_dir):
    from ..plans.reports import entries_page as page
    return page(entries(spark, sf_dir), PAGE_OFFSET, PAGE_LIMIT, since=PAGE_SINCE, until=PAGE_UNTIL,
                severity=PAGE_SEVERITY).select("session_name", "row_no", "id", "timestamp", "severity",
                                               "service", "total")


@query
def entries_since(spark, sf_dir):
    return Fl.entries_since(entries(spark, sf_dir), SINCE).select("id", "session_name", "timestamp", "severity")


@query
def normalize_content(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("id", normalize_full(F.col("raw_content")).alias("normalized"),
                    normalize_signature(F.col("raw_content")).alias("normalized_signature"),
                    F.md5(normalize_signature(F.col("raw_content"))).alias("signature"))


# ---- step 3: aggregates, buffers, liveness ----------------------------------

@query
def count_by_severity(spark, sf_dir):
    return A.count_by_severity(durable_rows(entries(spark, sf_dir)), DURABLE_SINCE)


@query
def services_by_freq(spark, sf_dir):
    return A.services_by_frequency(entries(spark, sf_dir))


@query
def snapshot_scan(spark, sf_dir):
    return L.snapshot_scan(log_lines(spark, sf_dir), RING_CAPACITY).select("pane_id", "sequence", "raw")


@query
def ring_last_n(spark, sf_dir):
    return L.ring_last_n(entries(spark, sf_dir), RING_CAPACITY).select("id", "pane_id", "sequence")


@query
def retention_trim(spark, sf_dir):
    return L.retention_trim(entries(spark, sf_dir), AS_OF, RETENTION_S).select("id", "pane_id", "sequence")


@query
def buffer_stats(spark, sf_dir):
    return A.buffer_stats(entries(spark, sf_dir), BUFFER_CAPACITY)


@query
def session_liveness(spark, sf_dir):
    return L.session_liveness(entries(spark, sf_dir), AS_OF, STALE_AFTER_S, DISCONNECT_AFTER_S)


@query
def stale_sessions(spark, sf_dir):
    return L.stale_sessions(entries(spark, sf_dir), AS_OF, STALE_AFTER_S)


@query
def session_list(spark, sf_dir):
    """L3."""
    return L.sessions(entries(spark, sf_dir)).withColumn("pane_ids", F.array_join("pane_ids", ","))


@query
def fresh_entries(spark, sf_dir):
    """L2 applied: entries of the sessions that are not stale."""
    return L.purge_stale(entries(spark, sf_dir), AS_OF, STALE_AFTER_S).select("id", "session_name")


# ---- step 4: patterns -------------------------------------------------------

@query
def pattern_rollup(spark, sf_dir):
    return Pt.pattern_rollup(signed(spark, sf_dir))


@query
def first_seen(spark, sf_dir):
    return Pt.first_seen(signed(spark, sf_dir))


@query
def entries_for_pattern(spark, sf_dir):
    s = signed(spark, sf_dir)
    frequent = Pt.pattern_rollup(s).where(F.col("occurrence_count") >= RECURRING_THRESHOLD)
    return Pt.entries_for_patterns(s, frequent).select("session_name", "signature", "id")


@query
def pattern_sample(spark, sf_dir):
    return Pt.pattern_samples(signed(spark, sf_dir))


@query
def top_patterns(spark, sf_dir):
    return Pt.top_patterns(Pt.pattern_rollup(signed(spark, sf_dir)), TOP_K).select(
        "session_name", "rank", "signature", "occurrence_count", "first_seen", "severity")


# ---- step 5: anchored windows, restart loops, error rate ---------------------

def pattern_windows(spark, sf_dir):
    """W1 over the materialised core table (the fold reads its input twice:
    hot-key count and fold)."""
    return Pt.pattern_windows(core_entries(spark, sf_dir), PATTERN_WINDOW_S)


@query
def recurring_errors(spark, sf_dir):
    return Pt.recurring_windows(pattern_windows(spark, sf_dir), RECURRING_THRESHOLD)


@query
def restart_loops(spark, sf_dir):
    return W.restart_loops(core_entries(spark, sf_dir), RESTART_WINDOW_S)


@query
def looping_services(spark, sf_dir):
    """W7 at a moment: services whose latest window is young and has two transitions."""
    c = core_entries(spark, sf_dir).where(F.col("timestamp") <= F.lit(LOOP_AS_OF))
    return W.looping_services(c, RESTART_WINDOW_S, LOOP_AS_OF)


@query
def restart_cycle(spark, sf_dir):
    return W.restart_cycles(entries(spark, sf_dir), RESTART_WINDOW_S)


@query
def error_rate(spark, sf_dir):
    return W.error_rate(entries(spark, sf_dir), RATE_WINDOW_S).select("id", "session_name", "rate_key", "rate")


# ---- step 6: incidents and alerts -------------------------------------------

def core_entries(spark, sf_dir, e: DataFrame | None = None) -> DataFrame:
    """The parsed columns the pattern, rate and restart operators need (no
    text), checkpointed once: several branches read it, so the parse and the
    fold below run once per query instead of once per branch."""
    from ..session import materialize
    e = e if e is not None else signed(spark, sf_dir)
    return materialize(e.select("id", "session_name", "signature", "timestamp", "pane_id", "sequence",
                                "severity", "sev_rank", "service",
                                W.service_state(F.col("raw_content")).alias("state")))


def core_windows(spark, sf_dir, e: DataFrame | None = None):
    """(core entries, their pattern windows); both checkpointed."""
    from ..session import materialize
    c = core_entries(spark, sf_dir, e)
    return c, materialize(Pt.pattern_windows(c, PATTERN_WINDOW_S))


def incident_table(spark, sf_dir, windows: DataFrame | None = None) -> DataFrame:
    w = windows if windows is not None else core_windows(spark, sf_dir)[1]
    return I.incidents(Pt.incident_triggers(w, RECURRING_THRESHOLD))


def alert_table(spark, sf_dir, core=None) -> DataFrame:
    return K.dedup_alerts(alert_triggers(*(core if core is not None else core_windows(spark, sf_dir))))


def alert_triggers(e: DataFrame, w: DataFrame) -> DataFrame:
    """K1-K4: the trigger rows of all four alert types."""
    return (K.recurring_triggers(w, PATTERN_WINDOW_S, RECURRING_THRESHOLD)
            .unionByName(K.new_exception_triggers(w))
            .unionByName(K.error_rate_triggers(W.error_rate(e, RATE_WINDOW_S), RATE_WINDOW_S, RATE_THRESHOLD))
            .unionByName(K.restart_loop_triggers(W.restart_windows(e, RESTART_WINDOW_S))))


def _incident_rows(table: DataFrame) -> DataFrame:
    return table.select(
        "id", "session_name", "title", "severity", "status", "started_at", "entry_count", "signature",
        F.array_join("affected_services", ",").alias("affected_services"),
        F.size("pattern_ids").alias("pattern_count"))


def _alert_rows(table: DataFrame) -> DataFrame:
    return table.select(
        "id", "session_name", "alert_type", "pattern_id", "threshold", "current_value", "triggered_at",
        "status", "message", "severity", "trigger_count")


@query
def incidents(spark, sf_dir):
    return _incident_rows(incident_table(spark, sf_dir))


@query
def alerts(spark, sf_dir):
    return _alert_rows(alert_table(spark, sf_dir))


def _act(name: str, days: int, since: str = "started_at"):
    return F.struct(F.lit(name).alias("action"), (F.col(since) + F.expr(f"INTERVAL {days} DAYS")).alias("at"))


def incident_lifecycle_table(spark, sf_dir) -> DataFrame:
    """Silence resolves, and people act: by the first digit of its id an
    incident is mitigated after a day (0 to 7) or resolved after two (4 to 9)."""
    trig = Pt.incident_triggers(core_windows(spark, sf_dir)[1], RECURRING_THRESHOLD)
    digit = F.substring("id", 1, 1)
    acts = (I.incidents(trig).select(
        "session_name", "signature", F.explode(F.filter(F.array(
            F.when(digit <= "7", _act("mitigate", 1)),
            F.when(digit.between("4", "9"), _act("resolve", 2))), lambda a: a.isNotNull())).alias("_a"))
        .select("session_name", "signature", "_a.*"))
    return I.incidents(trig, as_of=AS_OF, auto_resolve_s=AUTO_RESOLVE_S, actions=acts)


@query
def incident_lifecycle(spark, sf_dir):
    return incident_lifecycle_table(spark, sf_dir).select("id", "session_name", "signature", "status", "resolved_at")


@query
def service_incidents(spark, sf_dir):
    """incidents still active that touch one service."""
    return _incident_rows(Fl.affecting_service(Fl.active_only(incident_lifecycle_table(spark, sf_dir)),
                                               AFFECTED_SERVICE))


@query
def alert_actions(spark, sf_dir):
    """K6: the first alert of a key is acknowledged after a day if its key's
    digest begins with 0 to 7 and resolved after three if with 4 to b; a later
    trigger opens the next alert."""
    trig = alert_triggers(*core_windows(spark, sf_dir))
    digit = F.substring(F.md5(F.concat_ws("|", "session_name", "alert_type", "_key")), 1, 1)
    first = trig.groupBy("session_name", "alert_type", "_key").agg(F.min("timestamp").alias("opened"))
    acts = (first.select(
        "session_name", "alert_type", F.col("_key").alias("key"), F.explode(F.filter(F.array(
            F.when(digit <= "7", _act("acknowledge", 1, "opened")),
            F.when(digit.between("4", "b"), _act("resolve", 3, "opened"))), lambda a: a.isNotNull())).alias("_a"))
        .select("session_name", "alert_type", "key", "_a.*"))
    return K.dedup_alerts(trig, acts).select(
        "id", "session_name", "alert_type", "pattern_id", "current_value", "triggered_at", "acknowledged_at",
        "status", "trigger_count")


@query
def pattern_spikes(spark, sf_dir):
    """I5."""
    return I.spike_windows(pattern_windows(spark, sf_dir), PATTERN_SPIKE)


@query
def alert_dedup(spark, sf_dir):
    return alert_table(spark, sf_dir).groupBy("session_name", "alert_type").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("trigger_count").alias("triggers"))


@query
def unpatterned_spike(spark, sf_dir):
    return A.unpatterned_spike(entries(spark, sf_dir), SPIKE_WINDOW, SPIKE_MIN_ERRORS).withColumn(
        "affected_services", F.array_join("affected_services", ","))


@query
def pattern_lifecycle(spark, sf_dir):
    return Pt.pattern_lifecycle(pattern_windows(spark, sf_dir), AS_OF, RECURRING_THRESHOLD,
                                RECURRING_AFTER_S, RESOLVED_AFTER_S)


@query
def incident_patterns(spark, sf_dir):
    c, w = core_windows(spark, sf_dir)
    return I.incident_patterns(incident_table(spark, sf_dir, w), durable_rows(c))


@query
def session_stats(spark, sf_dir):
    c, w = core_windows(spark, sf_dir)
    pats = c.select("session_name", "signature").distinct()
    return A.session_stats(c, pats, incident_table(spark, sf_dir, w), alert_table(spark, sf_dir, (c, w)))


# ---- step 7: SimHash, near duplicates, leader clusters ----------------------

def documents(spark, sf_dir) -> DataFrame:
    from ..sources.fixtures import table
    return table(spark, sf_dir, "documents")


def doc_codes(spark, sf_dir) -> DataFrame:
    return Cl.simhash_codes(documents(spark, sf_dir).select("doc_id", "text"), F.col("text")).drop("text")


def _split_h(c):
    return F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(0xFFFFFFFF))


@query
def simhash_codes(spark, sf_dir):
    return doc_codes(spark, sf_dir).select("doc_id", "hi", "lo")


def doc_hashes(spark, sf_dir) -> DataFrame:
    """Distinct document hashes, checkpointed: the table is read by both
    sides of the band self-join (a Python UDF upstream defeats exchange reuse)."""
    from ..session import materialize
    return materialize(Cl.distinct_hashes(doc_codes(spark, sf_dir), [], ["doc_id"], "doc_id"))


@query
def near_dup_pairs(spark, sf_dir):
    return Cl.near_duplicate_pairs(doc_hashes(spark, sf_dir), []).select("a_hi", "a_lo", "b_hi", "b_lo", "distance")


@query
def leader_clusters(spark, sf_dir):
    h = doc_hashes(spark, sf_dir)
    assign = Cl.leader_scan(h, [])
    lead = h.select(F.col("h").alias("leader"), F.col("first_member").alias("leader_doc"))
    hi, lo = _split_h(F.col("leader"))
    return (assign.join(lead, "leader")
            .select("hi", "lo", F.col("first_member").alias("first_doc"), "members", "is_leader",
                    hi.alias("leader_hi"), lo.alias("leader_lo"), "leader_doc"))


@query
def dedup_lines(spark, sf_dir):
    """D4/D5/D8 on log lines: per session one row per near-duplicate group."""
    hi, lo = _split_h(F.col("leader"))
    return line_clusters(spark, sf_dir).select("session_name", hi.alias("leader_hi"), lo.alias("leader_lo"),
                                               "representative", "last_member", "members", "distinct_hashes")


def line_clusters(spark, sf_dir, e: DataFrame | None = None) -> DataFrame:
    """Leader clusters of the log lines of each session, with their counts."""
    e = (e if e is not None else entries(spark, sf_dir)).select("id", "session_name", "timestamp", "pane_id", "sequence", "raw_content")
    from ..session import materialize
    codes = Cl.simhash_codes(e, F.col("raw_content")).drop("raw_content")
    h = materialize(Cl.distinct_hashes(codes, ["session_name"], Pt.ORDER, "id"))
    assign = Cl.leader_scan(h, ["session_name"])
    return Cl.cluster_stats(assign, ["session_name"])


@query
def recent_clusters(spark, sf_dir):
    """The clusters of each session that were seen last."""
    c = line_clusters(spark, sf_dir).withColumn("last_seen", F.col("last_rank.timestamp"))
    return Cl.bounded_clusters(c.select("session_name", "last_seen", "last_member", "representative", "members"),
                               ["session_name"], "last_seen", CLUSTER_LIMIT)


def core_clustered(spark, sf_dir) -> DataFrame:
    """``core_entries`` with the signature of each line's cluster in place of
    its own: lines whose hashes differ by at most 3 bits from a leader share
    the signature of that leader's first line (D4 feeding W1-W4, I1, K1-K5)."""
    from ..session import materialize
    # signature and SimHash from one pass of the rules that they share
    e = entries(spark, sf_dir).withColumn("_text", normalize_signature(F.col("raw_content")))
    coded = materialize(Cl.simhash_codes(e.select(
        "id", "session_name", F.md5("_text").alias("signature"), "timestamp", "pane_id", "sequence", "severity", "sev_rank", "service",
        W.service_state(F.col("raw_content")).alias("state"), mask_addresses(F.col("_text")).alias("_text")),
        F.col("_text"), normalize=False).drop("_text"))
    h = materialize(Cl.distinct_hashes(coded, ["session_name"], Pt.ORDER, "signature"))
    assign = Cl.leader_scan(h, ["session_name"])
    keys = Cl.cluster_signatures(h, assign, ["session_name"])
    return materialize(join_keys(coded.drop("signature", "hi", "lo"), keys, ["session_name", "h"]).drop("h"))


def clustered_windows(spark, sf_dir):
    from ..session import materialize
    c = core_clustered(spark, sf_dir)
    return c, materialize(Pt.pattern_windows(c, PATTERN_WINDOW_S))


@query
def cluster_recurring(spark, sf_dir):
    """W1/W2 by cluster."""
    return Pt.recurring_windows(Pt.pattern_windows(core_clustered(spark, sf_dir), PATTERN_WINDOW_S),
                                RECURRING_THRESHOLD)


@query
def cluster_incidents(spark, sf_dir):
    """I1 by cluster."""
    return _incident_rows(incident_table(spark, sf_dir, clustered_windows(spark, sf_dir)[1]))


@query
def cluster_alerts(spark, sf_dir):
    """K1-K5 by cluster."""
    return _alert_rows(alert_table(spark, sf_dir, clustered_windows(spark, sf_dir)))


@query
def cluster_totals(spark, sf_dir):
    """Clusters of each session, and its patterns not yet resolved at ``AS_OF``."""
    e = parsed_once(spark, sf_dir)
    windows = Pt.pattern_windows(core_entries(spark, sf_dir, Pt.with_signature(e)), PATTERN_WINDOW_S)
    life = Pt.pattern_lifecycle(windows, AS_OF, RECURRING_THRESHOLD, RECURRING_AFTER_S, RESOLVED_AFTER_S)
    return A.pattern_totals(line_clusters(spark, sf_dir, e), life.where(F.col("state") != "Resolved"))


# ---- step 8: reports --------------------------------------------------------

@query
def window_summary(spark, sf_dir):
    from .reports import window_summary as summary
    c, w = core_windows(spark, sf_dir)
    recent = (c.where(F.col("timestamp") >= F.lit(SUMMARY_START)).groupBy("session_name", "signature")
              .agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("timestamp").alias("first_seen"),
                   F.max("timestamp").alias("last_seen")))
    return summary(c, SUMMARY_START, recent, incident_table(spark, sf_dir, w), alert_table(spark, sf_dir, (c, w)))


@query
def incident_digest(spark, sf_dir):
    from .reports import incident_digest as digest
    return digest(entries(spark, sf_dir), DIGEST_LEVEL, DIGEST_SINCE)


@query
def severity_order(spark, sf_dir):
    """O5."""
    from .reports import severity_rows
    return severity_rows(entries(spark, sf_dir)).select("session_name", "position", "severity", "entry_count")


@query
def token_budget(spark, sf_dir):
    from ..sources.fixtures import table
    from .reports import token_budget as budget
    return budget(table(spark, sf_dir, "conversations"), TOKEN_BUDGET)


@query
def status_overview(spark, sf_dir):
    from .reports import status_overview as overview
    c, w = core_windows(spark, sf_dir)
    live = L.session_liveness(entries(spark, sf_dir), AS_OF, STALE_AFTER_S, DISCONNECT_AFTER_S)
    pats = c.select("session_name", "signature").distinct()
    stats = A.session_stats(c, pats, incident_table(spark, sf_dir, w), alert_table(spark, sf_dir, (c, w)))
    return overview(live, stats)


@query
def quick_summary(spark, sf_dir):
    from .reports import quick_summary as quick
    return quick(W.error_rate(entries(spark, sf_dir), RATE_WINDOW_S))


# ---- step 9: custom patterns, multi-line, validation, prefix signature ------

@query
def custom_patterns(spark, sf_dir):
    from ..functions.parse import custom_pattern_fields
    e = entries(spark, sf_dir)
    m = e.select("id", custom_pattern_fields(F.col("raw_content"), CUSTOM_PATTERNS).alias("m"))
    return m.where(F.col("m").isNotNull()).select("id", "m.*")


@query
def collapse_multiline(spark, sf_dir):
    from ..operators.multiline import collapse_multiline as collapse
    return collapse(entries(spark, sf_dir), F.col("raw_content").rlike(MULTILINE_START))


@query
def validate_entries(spark, sf_dir):
    from ..operators.multiline import validate_entries as validate
    return validate(entries(spark, sf_dir))


@query
def prefix_signature(spark, sf_dir):
    from ..functions.text import prefix_signature as prefix
    e = entries(spark, sf_dir)
    return e.select("id", prefix(F.col("severity"), F.col("raw_content")).alias("prefix_signature"))


@query
def source_preview(spark, sf_dir):
    from ..functions.text import preview, source_label
    e = entries(spark, sf_dir)
    return e.select("id", source_label(F.col("service"), F.col("pane_id")).alias("source"),
                    preview(F.col("raw_content")).alias("preview"))


# ---- durable store and upserts ----------------------------------------------

def durable_store(spark, sf_dir) -> str:
    """Severe entries appended to a new durable table in the shared folder."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources.sinks import append_durable
    path = f"{checkpoint_dir(spark).rstrip('/')}/logweave-durable-{uuid.uuid4().hex}"
    rows = durable_rows(entries(spark, sf_dir)).select(
        "id", "session_name", "pane_id", "sequence", "timestamp", "received_at", "severity", "date")
    append_durable(rows, path)
    return path


@query
def durable_range(spark, sf_dir):
    from ..sources.sinks import read_range
    return read_range(spark, durable_store(spark, sf_dir), PAGE_SINCE, PAGE_UNTIL).select(
        "id", "session_name", "severity", "timestamp")


@query
def durable_purge(spark, sf_dir):
    from ..sources.sinks import purge_before, stored
    path = durable_store(spark, sf_dir)
    purge_before(spark, path, DURABLE_SINCE)
    return stored(spark, path).groupBy("session_name").agg(
        F.count(F.lit(1)).alias("kept"), F.min("timestamp").alias("oldest"))


@query
def upsert_latest(spark, sf_dir):
    from ..sources.sinks import latest_by_id
    e = entries(spark, sf_dir)
    versions = e.select(F.concat("session_name", F.lit("/"), F.coalesce("service", F.lit("-"))).alias("id"),
                        F.col("id").alias("entry_id"), F.col("timestamp").alias("updated_at"))
    return latest_by_id(versions)


# ---- restarted captures, shared panes, a silent session -----------------------

def restarted(spark, sf_dir) -> DataFrame:
    return parse_entries(restarted_lines(spark, sf_dir))


def restarted_core(spark, sf_dir):
    from ..session import materialize
    c = core_entries(spark, sf_dir, Pt.with_signature(restarted(spark, sf_dir)))
    return c, materialize(Pt.pattern_windows(c, PATTERN_WINDOW_S))


@query
def restarted_parse(spark, sf_dir):
    return restarted(spark, sf_dir).drop("parsed_fields")


@query
def restarted_collapse(spark, sf_dir):
    """P16 with stack-trace lines, by session, pane and arrival."""
    from ..operators.multiline import collapse_multiline as collapse
    return collapse(restarted(spark, sf_dir))


@query
def restarted_retention(spark, sf_dir):
    """W13."""
    return L.retention_trim(restarted(spark, sf_dir), AS_OF, RETENTION_S).select(
        "id", "session_name", "pane_id", "sequence")


@query
def restarted_liveness(spark, sf_dir):
    """L4."""
    return L.session_liveness(restarted(spark, sf_dir), AS_OF, STALE_AFTER_S, DISCONNECT_AFTER_S)


@query
def restarted_fresh(spark, sf_dir):
    """L2: the silent session's lines are gone."""
    return L.purge_stale(restarted(spark, sf_dir), AS_OF, STALE_SESSION_S).groupBy("session_name").agg(
        F.count(F.lit(1)).alias("lines"))


@query
def restarted_cycle(spark, sf_dir):
    """W8."""
    return W.restart_cycles(restarted(spark, sf_dir), CYCLE_WINDOW_S)


@query
def restarted_error_rate(spark, sf_dir):
    """W9."""
    return W.error_rate(restarted(spark, sf_dir), RATE_WINDOW_S).select("id", "session_name", "rate_key", "rate")


@query
def restarted_incidents(spark, sf_dir):
    """W4, I1."""
    return _incident_rows(I.incidents(Pt.incident_triggers(restarted_core(spark, sf_dir)[1], RECURRING_THRESHOLD)))


@query
def restarted_alerts(spark, sf_dir):
    """K1-K5."""
    return _alert_rows(alert_table(spark, sf_dir, restarted_core(spark, sf_dir)))


@query
def restarted_samples(spark, sf_dir):
    """J3."""
    return Pt.pattern_samples(Pt.with_signature(restarted(spark, sf_dir)))


@query
def leader_clusters_ttl(spark, sf_dir):
    """Clusters of lines whose leader takes lines for ``LEADER_TTL_S``."""
    from ..operators.lives import leader_lives
    from ..session import materialize
    e = entries(spark, sf_dir).select("id", "session_name", "timestamp", "pane_id", "sequence", "raw_content")
    codes = materialize(Cl.simhash_codes(e, F.col("raw_content")).drop("raw_content"))
    order = Pt.order_struct()
    hi, lo = _split_h(F.col("leader"))
    return leader_lives(codes, ["session_name"], ["pane_id", "sequence"], LEADER_TTL_S).groupBy(
        "session_name", hi.alias("leader_hi"), lo.alias("leader_lo"), "led_at").agg(
        F.min_by("id", order).alias("representative"), F.max_by("id", order).alias("last_member"),
        F.count(F.lit(1)).alias("members"), F.count_distinct("h").alias("distinct_hashes"))


@query
def context_selection(spark, sf_dir):
    """Incidents, patterns and entries of each session under one token budget."""
    from .reports import context_items, context_selection as select
    s = Pt.with_signature(parsed_once(spark, sf_dir))
    inc = I.incidents(Pt.incident_triggers(core_windows(spark, sf_dir, s)[1], RECURRING_THRESHOLD))
    return select(context_items(inc, Pt.pattern_rollup(s), s), CONTEXT_BUDGET)


def _batches(df: DataFrame, time: str):
    """Stand-in for a feed: the rows by stretches of days, numbered."""
    cuts = [None, dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21), None]
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = df if low is None else df.where(F.col(time) >= F.lit(low))
        yield i, part if high is None else part.where(F.col(time) < F.lit(high))


@query
def upsert_store(spark, sf_dir):
    """S8 on a stored table: versions merged by batches, one of them twice."""
    from ..sources.keyed_table import merge_batch, read_table
    from ..sources.sinks import latest_by_id
    e = entries(spark, sf_dir)
    versions = e.select(F.concat("session_name", F.lit("/"), F.coalesce("service", F.lit("-"))).alias("id"),
                        F.col("id").alias("entry_id"), F.col("timestamp").alias("updated_at"))
    path = stream_catalog.folder(spark, "keyed")
    for i, part in _batches(versions, "updated_at"):
        for _ in range(2 if i == 1 else 1):
            merge_batch(part, path, ["id"], i, latest_by_id)
    return read_table(spark, path)


def _pattern_store(spark, sf_dir):
    """The pattern table by batches; yields (batch, its rows, path) before each merge."""
    from ..session import materialize
    from ..sources.keyed_table import merge_batch
    s = signed(spark, sf_dir).select("id", "session_name", "signature", "timestamp", "pane_id", "sequence", "sev_rank", "raw_content")
    path = stream_catalog.folder(spark, "patterns")
    for i, part in _batches(s, "timestamp"):
        part = materialize(Pt.partial_rollup(part))
        yield i, part, path
        for _ in range(2 if i == 1 else 1):
            merge_batch(part, path, ["session_name", "signature"], i, Pt.merge_rollups)


@query
def pattern_store(spark, sf_dir):
    """A6 incrementally: parts of batches merged in a stored table, one of them twice."""
    from ..sources.keyed_table import read_table
    path = [path for _, _, path in _pattern_store(spark, sf_dir)][-1]
    return Pt.finish_rollup(read_table(spark, path))


@query
def new_patterns(spark, sf_dir):
    """J5 incrementally: the patterns of each batch that no earlier one stored."""
    from ..session import materialize
    from ..sources.keyed_table import unknown_keys
    out = None
    for i, part, path in _pattern_store(spark, sf_dir):
        new = materialize(unknown_keys(part, path, ["session_name", "signature"]).withColumn("batch", F.lit(i)))
        out = new if out is None else out.unionByName(new)
    return out


@query
def severity_map(spark, sf_dir):
    """A2 as a map."""
    return A.severity_map(entries(spark, sf_dir)).select("session_name", F.array_join(F.array_sort(F.transform(
        F.map_entries("by_severity"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",").alias("by_severity"))


@query
def pipeline_counters(spark, sf_dir):
    """A11."""
    e = parsed_once(spark, sf_dir)
    c, w = core_windows(spark, sf_dir, Pt.with_signature(e))
    return A.pipeline_counters(e, line_clusters(spark, sf_dir, e), c.select("session_name", "signature").distinct(),
                               incident_table(spark, sf_dir, w), alert_table(spark, sf_dir, (c, w)))


# ---- documents, services, panes ------------------------------------------------

@query
def entries_document(spark, sf_dir):
    """R2, S7 with the service filter of F8."""
    from .reports import entry_documents
    lines = Fl.lines_of(log_lines(spark, sf_dir), PAGE_SEVERITY, AFFECTED_SERVICE)
    return entry_documents(parse_entries(lines), DOCUMENT_LIMIT, 2, PAGE_SINCE, PAGE_SEVERITY, AFFECTED_SERVICE)


@query
def patterns_document(spark, sf_dir):
    """R3, S7."""
    from .reports import pattern_documents
    return pattern_documents(Pt.pattern_rollup(signed(spark, sf_dir)), DOCUMENT_LIMIT)


@query
def incidents_document(spark, sf_dir):
    """R3, S7."""
    from .reports import incident_documents
    return incident_documents(incident_lifecycle_table(spark, sf_dir), DOCUMENT_LIMIT)


@query
def alerts_document(spark, sf_dir):
    """R3, S7."""
    from .reports import alert_documents
    return alert_documents(alert_table(spark, sf_dir), DOCUMENT_LIMIT)


@query
def service_level(spark, sf_dir):
    """F8: one service and level, by the text before the parse and exactly after it."""
    lines = Fl.lines_of(log_lines(spark, sf_dir), "WARN", AFFECTED_SERVICE)
    return Fl.entries_query(parse_entries(lines), severity="WARN", service=AFFECTED_SERVICE).select(
        "id", "session_name", "timestamp", "severity", "service")


@query
def search_severity(spark, sf_dir):
    """F9 with a severity."""
    lines = Fl.lines_of(Fl.lines_with(log_lines(spark, sf_dir), SEARCH_NEEDLE), PAGE_SEVERITY)
    return Fl.search_text(parse_entries(lines), SEARCH_NEEDLE, PAGE_SEVERITY)


@query
def durable_pane(spark, sf_dir):
    """One pane of the durable table."""
    from ..sources.sinks import read_pane
    return read_pane(spark, durable_store(spark, sf_dir), FILTER_PANE).select("id", "session_name", "sequence", "severity")


@query
def durable_session(spark, sf_dir):
    """S5 with a level and a session."""
    from ..sources.sinks import read_range
    return read_range(spark, durable_store(spark, sf_dir), PAGE_SINCE, PAGE_UNTIL, "FATAL", "sess-1").select(
        "id", "pane_id", "timestamp")


@query
def errors_summary(spark, sf_dir):
    """The counts of R1 over ERROR and FATAL lines only."""
    from .reports import errors_only
    e = errors_only(entries(spark, sf_dir)).where(F.col("timestamp") >= F.lit(SUMMARY_START))
    return e.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "FATAL").alias("n_fatal"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"), F.max("timestamp").alias("last_seen"))


from . import stream_catalog  # noqa: E402,F401  registers the streaming queries
