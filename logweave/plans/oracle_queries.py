"""SQL twin of every catalog query (DuckDB dialect)."""

from __future__ import annotations

from . import catalog as C
from ..functions.simhash import whitespace_class_regex
from .oracle import (LOG_LINES_CTE, RESTARTED_CTE, anchored_sql, fields_text_sql, keyword_case, level_of_sql, normalize_sql, q,
                     rank_case, signature_sql, with_entries)

ORACLE: dict[str, str] = {}


def ts(d) -> str:
    return f"TIMESTAMP '{d:%Y-%m-%d %H:%M:%S}'"


AS_OF = ts(C.AS_OF)
KW = keyword_case("raw_content")
SIG = f"sig AS (SELECT *, {signature_sql('raw_content')} AS signature FROM entries)"
FIRST = ("sigr AS (SELECT *, row_number() OVER (PARTITION BY session_name, signature "
         "ORDER BY timestamp, pane_id, sequence) AS rn FROM sig)")
PW = anchored_sql("pw", "sig", ["session_name", "signature"], "timestamp", ["pane_id", "sequence"],
                  C.PATTERN_WINDOW_S)
PWF = ("pwf AS (SELECT pw.*, row_number() OVER (PARTITION BY session_name, signature "
       "ORDER BY timestamp, pane_id, sequence) AS rn FROM pw)")
STATE = ("CASE WHEN contains(lower(raw_content), 'starting') OR contains(lower(raw_content), 'start ') "
         "THEN 'Starting' WHEN contains(lower(raw_content), 'stopping') OR contains(lower(raw_content), 'stop ') "
         "THEN 'Stopping' WHEN contains(lower(raw_content), 'stopped') OR contains(lower(raw_content), 'shutdown') "
         "THEN 'Stopped' WHEN contains(lower(raw_content), 'started') OR contains(lower(raw_content), 'ready') "
         "THEN 'Running' END")
TRANS = (f"tr0 AS (SELECT *, {STATE} AS state, coalesce(service, 'unknown') AS restart_service FROM entries), "
         "trans AS (SELECT * FROM tr0 WHERE state IS NOT NULL)")
RW = anchored_sql("rw", "trans", ["session_name", "restart_service"], "timestamp", ["pane_id", "sequence"],
                  C.RESTART_WINDOW_S)
RATES = ("rates AS (SELECT id, session_name, rate_key, timestamp, pane_id, sequence, count(*) OVER ("
         "PARTITION BY session_name, rate_key ORDER BY timestamp RANGE BETWEEN "
         f"INTERVAL '{C.RATE_WINDOW_S} seconds' PRECEDING AND CURRENT ROW) AS rate FROM ("
         "SELECT *, coalesce(service, '_global') AS rate_key FROM entries WHERE sev_rank >= 4))")

# ---- step 1 ---------------------------------------------------------------
ORACLE["parse_entries"] = with_entries(
    "SELECT id, session_name, pane_id, sequence, timestamp, ts_source, severity, sev_rank, service, "
    "raw_content, received_at FROM entries")
ORACLE["parse_kv_fields"] = with_entries(
    f"SELECT id, {fields_text_sql('field_pairs')} AS fields FROM entries")
ORACLE["severity_distribution"] = with_entries(
    "SELECT session_name, service, severity, count(*) AS entry_count, min(sev_rank) AS sev_rank "
    "FROM entries GROUP BY session_name, service, severity")

# ---- step 2 ---------------------------------------------------------------
ORACLE["classify_severity"] = with_entries(f"SELECT id, {KW} AS keyword_severity FROM entries")
ORACLE["line_filter"] = with_entries(
    f"SELECT id, pane_id, sequence, kw AS detected_severity FROM (SELECT *, {KW} AS kw FROM entries) "
    f"WHERE {rank_case('kw')} >= 4")
ORACLE["line_filter_regex"] = with_entries(
    f"SELECT id, pane_id, sequence, {KW} AS detected_severity FROM entries "
    f"WHERE regexp_matches(raw_content, {q(C.FILTER_REGEX)})")
ORACLE["context_lines"] = with_entries(
    f"SELECT e.id, e.pane_id, e.sequence, {keyword_case('e.raw_content')} = 'FATAL' AS is_match, "
    "count(*) AS matches_near FROM entries e JOIN m ON m.pane_id = e.pane_id "
    f"AND m.hit BETWEEN e.sequence - {C.CONTEXT_LINES} AND e.sequence + {C.CONTEXT_LINES} "
    "GROUP BY e.id, e.pane_id, e.sequence, e.raw_content",
    f"m AS (SELECT pane_id, sequence AS hit FROM entries WHERE {KW} = 'FATAL')")
ORACLE["search_text"] = with_entries(
    "SELECT session_name, rank, id, pane_id, sequence, line FROM (SELECT session_name, "
    "row_number() OVER (PARTITION BY session_name ORDER BY pane_id, sequence) AS rank, id, pane_id, sequence, "
    "'[' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '] ' || raw_content AS line FROM entries "
    f"WHERE contains(raw_content, {q(C.SEARCH_NEEDLE)})) WHERE rank <= 50")
ORACLE["entries_page"] = with_entries(
    "SELECT p.session_name, row_no, id, timestamp, severity, service, total FROM "
    "(SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY timestamp, pane_id, sequence) AS row_no "
    "FROM f) p JOIN (SELECT session_name, count(*) AS total FROM f GROUP BY session_name) t "
    f"ON p.session_name = t.session_name WHERE row_no > {C.PAGE_OFFSET} AND row_no <= {C.PAGE_OFFSET + C.PAGE_LIMIT}",
    f"f AS (SELECT * FROM entries WHERE timestamp >= {ts(C.PAGE_SINCE)} AND timestamp <= {ts(C.PAGE_UNTIL)} "
    f"AND severity = {q(C.PAGE_SEVERITY.upper())})")
ORACLE["entries_since"] = with_entries(
    f"SELECT id, session_name, timestamp, severity FROM entries WHERE timestamp >= {ts(C.SINCE)}")
ORACLE["normalize_content"] = with_entries(
    f"SELECT id, {normalize_sql('raw_content', True)} AS normalized, "
    f"{normalize_sql('raw_content', False)} AS normalized_signature, {signature_sql('raw_content')} AS signature "
    "FROM entries")

# ---- step 3 ---------------------------------------------------------------
ORACLE["count_by_severity"] = with_entries(
    "SELECT session_name, severity, count(*) AS entry_count FROM entries "
    f"WHERE sev_rank >= 4 AND timestamp >= {ts(C.DURABLE_SINCE)} GROUP BY session_name, severity")
ORACLE["services_by_freq"] = with_entries(
    "SELECT session_name, service, entry_count, row_number() OVER (PARTITION BY session_name "
    "ORDER BY entry_count DESC, service) AS rank FROM (SELECT session_name, service, count(*) AS entry_count "
    "FROM entries WHERE service IS NOT NULL GROUP BY session_name, service)")
ORACLE["snapshot_scan"] = with_entries(
    "SELECT l.pane_id, l.sequence, trim(l.raw) AS raw FROM log_lines l JOIN (SELECT pane_id, max(sequence) AS m "
    f"FROM log_lines GROUP BY pane_id) t ON l.pane_id = t.pane_id WHERE l.sequence > t.m - {C.RING_CAPACITY} "
    "AND trim(l.raw) <> ''")
ORACLE["ring_last_n"] = with_entries(
    "SELECT e.id, e.pane_id, e.sequence FROM entries e JOIN (SELECT pane_id, max(sequence) AS m FROM entries "
    f"GROUP BY pane_id) t ON e.pane_id = t.pane_id WHERE e.sequence > t.m - {C.RING_CAPACITY}")
ORACLE["retention_trim"] = with_entries(
    "SELECT e.id, e.pane_id, e.sequence FROM entries e JOIN (SELECT pane_id, min(sequence) AS k FROM entries "
    f"WHERE timestamp >= {AS_OF} - INTERVAL '{C.RETENTION_S} seconds' GROUP BY pane_id) t "
    "ON e.pane_id = t.pane_id WHERE e.sequence >= t.k")
ORACLE["buffer_stats"] = with_entries(
    f"SELECT session_name, count(*) AS panes, CAST(sum(least(n, {C.BUFFER_CAPACITY})) AS BIGINT) AS entries, "
    f"CAST(count(*) * {C.BUFFER_CAPACITY} AS BIGINT) AS capacity, "
    f"CASE WHEN count(*) * {C.BUFFER_CAPACITY} > 0 THEN sum(least(n, {C.BUFFER_CAPACITY})) * 100.0 / "
    f"(count(*) * {C.BUFFER_CAPACITY}) ELSE 0.0 END AS utilization_pct "
    "FROM (SELECT session_name, pane_id, count(*) AS n FROM entries GROUP BY session_name, pane_id) "
    "GROUP BY session_name")
ORACLE["session_liveness"] = with_entries(
    "SELECT session_name, pane_id, lines, last_seen, stale_gaps, disconnect_gaps, idle_seconds, "
    f"CASE WHEN idle_seconds <= {C.STALE_AFTER_S} THEN 'Active' WHEN idle_seconds <= {C.DISCONNECT_AFTER_S} "
    "THEN 'Stale' ELSE 'Disconnected' END AS status FROM ("
    "SELECT a.session_name, a.pane_id, count(*) AS lines, max(a.received_at) AS last_seen, "
    f"count_if(epoch(b.received_at) - epoch(a.received_at) > {C.STALE_AFTER_S}) AS stale_gaps, "
    f"count_if(epoch(b.received_at) - epoch(a.received_at) > {C.DISCONNECT_AFTER_S}) AS disconnect_gaps, "
    f"epoch({AS_OF}) - epoch(max(a.received_at)) AS idle_seconds "
    "FROM entries a LEFT JOIN entries b ON a.pane_id = b.pane_id AND b.sequence = a.sequence + 1 "
    "GROUP BY a.session_name, a.pane_id)")
ORACLE["stale_sessions"] = with_entries(
    f"SELECT session_name, last_seen, idle_seconds, idle_seconds > {C.STALE_AFTER_S} AS is_stale FROM ("
    f"SELECT session_name, max(received_at) AS last_seen, epoch({AS_OF}) - epoch(max(received_at)) "
    "AS idle_seconds FROM entries GROUP BY session_name)")

# ---- step 4 ---------------------------------------------------------------
ROLLUP = (f"rollup AS (SELECT session_name, signature, {level_of_sql('max(sev_rank)')} AS severity, "
          "min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS occurrence_count, "
          "max(CASE WHEN rn = 1 THEN id END) AS sample_entry, max(CASE WHEN rn = 1 THEN raw_content END) "
          "AS sample_message FROM sigr GROUP BY session_name, signature)")
ORACLE["pattern_rollup"] = with_entries("SELECT * FROM rollup", f"{SIG}, {FIRST}, {ROLLUP}")
ORACLE["first_seen"] = with_entries(
    "SELECT session_name, signature, id AS entry_id, timestamp AS first_seen, severity, "
    "sev_rank >= 4 AS is_new_error FROM sigr WHERE rn = 1", f"{SIG}, {FIRST}")
ORACLE["entries_for_pattern"] = with_entries(
    "SELECT s.session_name, s.signature, s.id FROM sig s JOIN (SELECT session_name, signature FROM sig "
    f"GROUP BY session_name, signature HAVING count(*) >= {C.RECURRING_THRESHOLD}) f "
    "ON s.session_name = f.session_name AND s.signature = f.signature", SIG)
ORACLE["pattern_sample"] = with_entries(
    "SELECT session_name, signature, id AS sample_entry, pane_id, sequence, raw_content "
    "AS sample_message FROM sigr WHERE rn = 1", f"{SIG}, {FIRST}")
ORACLE["top_patterns"] = with_entries(
    "SELECT session_name, rank, signature, occurrence_count, first_seen, severity FROM (SELECT *, "
    "row_number() OVER (PARTITION BY session_name ORDER BY occurrence_count DESC, first_seen, signature) "
    f"AS rank FROM rollup) WHERE rank <= {C.TOP_K}", f"{SIG}, {FIRST}, {ROLLUP}")

# ---- step 5 ---------------------------------------------------------------
ORACLE["recurring_errors"] = with_entries(
    "SELECT session_name, signature, window_start, max(window_count) AS window_count, "
    f"min(CASE WHEN window_count = {C.RECURRING_THRESHOLD} THEN timestamp END) AS recurring_at, "
    "max(timestamp) AS last_seen FROM pw GROUP BY session_name, signature, window_start "
    f"HAVING max(window_count) >= {C.RECURRING_THRESHOLD}", f"{SIG}, {PW}")
ORACLE["restart_loops"] = with_entries(
    "SELECT session_name, restart_service, window_start, max(window_count) AS transitions, "
    "max(timestamp) AS last_transition, min(CASE WHEN window_count = 2 THEN timestamp END) AS loop_detected_at "
    "FROM rw GROUP BY session_name, restart_service, window_start HAVING max(window_count) >= 2",
    f"{TRANS}, {RW}")
ORACLE["restart_cycle"] = with_entries(
    "SELECT session_name, restart_service, t3 AS cycle_start, timestamp AS cycle_end, id FROM ("
    "SELECT *, lag(state, 1) OVER w AS s1, lag(state, 2) OVER w AS s2, lag(state, 3) OVER w AS s3, "
    "lag(timestamp, 3) OVER w AS t3 FROM trans WINDOW w AS (PARTITION BY session_name, restart_service "
    "ORDER BY timestamp, pane_id, sequence)) WHERE state = 'Starting' AND s1 = 'Stopping' AND s2 = 'Running' "
    f"AND s3 = 'Starting' AND epoch(timestamp) - epoch(t3) <= {C.RESTART_WINDOW_S}", TRANS)
ORACLE["error_rate"] = with_entries("SELECT id, session_name, rate_key, rate FROM rates", RATES)

# ---- step 6 ---------------------------------------------------------------
TRIG = (f"trig AS (SELECT *, row_number() OVER (PARTITION BY session_name, signature ORDER BY timestamp, "
        f"pane_id, sequence) AS trn FROM pwf WHERE window_count >= {C.RECURRING_THRESHOLD} "
        "OR (rn = 1 AND sev_rank >= 4))")
INCIDENTS = ("inc AS (SELECT md5(session_name || '|' || signature) AS id, session_name, "
             "'Pattern spike: ' || substr(signature, 1, 8) || ' (' || "
             "CAST(max(CASE WHEN trn = 1 THEN window_count END) AS VARCHAR) || ' occurrences)' AS title, "
             f"{level_of_sql('max(sev_rank)')} AS severity, 'Active' AS status, min(timestamp) AS started_at, "
             "count(*) - 1 AS entry_count, signature, coalesce(array_to_string(list_sort(list_distinct("
             "list(service) FILTER (WHERE service IS NOT NULL))), ','), '') AS affected_services, "
             "1 AS pattern_count FROM trig GROUP BY session_name, signature)")
INC_CTES = f"{SIG}, {PW}, {PWF}, {TRIG}, {INCIDENTS}"
ORACLE["incidents"] = with_entries("SELECT * FROM inc", INC_CTES)

REC_TRIG = (f"rec AS (SELECT *, max(sev_rank) OVER (PARTITION BY session_name, signature ORDER BY timestamp, "
            "pane_id, sequence ROWS UNBOUNDED PRECEDING) AS run_r FROM pw), "
            f"rec_first AS (SELECT session_name, signature, arg_min(run_r, (timestamp, pane_id, sequence)) AS r "
            f"FROM rec WHERE window_count >= {C.RECURRING_THRESHOLD} GROUP BY session_name, signature)")
ALL_TRIG = (
    "trig_all AS ("
    "SELECT rec.session_name, 'RecurringError' AS alert_type, rec.signature AS k, timestamp, pane_id, sequence, "
    "CAST(window_count AS DOUBLE) AS value, 'Recurring error: ' || CAST(window_count AS VARCHAR) || "
    "' occurrences in 1d' AS message, " + level_of_sql("rf.r") + " AS severity, rec.signature AS pattern_id, "
    f"CAST({C.RECURRING_THRESHOLD} AS DOUBLE) AS threshold FROM rec JOIN rec_first rf "
    "ON rec.session_name = rf.session_name AND rec.signature = rf.signature "
    f"WHERE window_count >= {C.RECURRING_THRESHOLD} "
    "UNION ALL SELECT session_name, 'NewException', signature, timestamp, pane_id, sequence, 1.0, "
    "'New unseen exception: ' || substr(signature, 1, 20), severity, signature, CAST(NULL AS DOUBLE) "
    "FROM sigr WHERE rn = 1 AND sev_rank >= 4 "
    "UNION ALL SELECT session_name, 'ErrorRate', '', timestamp, pane_id, sequence, CAST(rate AS DOUBLE), "
    "'Error rate ' || printf('%.1f', CAST(rate AS DOUBLE)) || '/1d exceeds threshold', 'WARN', "
    f"CAST(NULL AS VARCHAR), CAST({C.RATE_THRESHOLD} AS DOUBLE) FROM rates WHERE rate_key = '_global' "
    f"AND rate >= {C.RATE_THRESHOLD} "
    "UNION ALL SELECT session_name, 'RestartLoop', restart_service, timestamp, pane_id, sequence, 1.0, "
    "'Service restart loop detected: ' || restart_service, 'ERROR', CAST(NULL AS VARCHAR), "
    "CAST(NULL AS DOUBLE) FROM rw WHERE window_count >= 2)")
ALERTS = (
    "al AS (SELECT md5(session_name || '|' || alert_type || '|' || k || '|' || "
    "strftime(min(timestamp), '%Y-%m-%d %H:%M:%S.%f')) AS id, session_name, alert_type, "
    "arg_min(pattern_id, (timestamp, pane_id, sequence)) AS pattern_id, "
    "arg_min(threshold, (timestamp, pane_id, sequence)) AS threshold, "
    "arg_max(value, (timestamp, pane_id, sequence)) AS current_value, min(timestamp) AS triggered_at, "
    "'Active' AS status, arg_min(message, (timestamp, pane_id, sequence)) AS message, "
    "arg_min(severity, (timestamp, pane_id, sequence)) AS severity, count(*) AS trigger_count "
    "FROM trig_all GROUP BY session_name, alert_type, k)")
ALERT_CTES = f"{SIG}, {FIRST}, {PW}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, {ALERTS}"
ORACLE["alerts"] = with_entries("SELECT * FROM al", ALERT_CTES)
ORACLE["alert_dedup"] = with_entries(
    "SELECT session_name, alert_type, count(*) AS alerts, CAST(sum(trigger_count) AS BIGINT) AS triggers "
    "FROM al GROUP BY session_name, alert_type", ALERT_CTES)
ORACLE["unpatterned_spike"] = with_entries(
    "SELECT session_name, date_trunc('day', timestamp) AS window_start, "
    "date_trunc('day', timestamp) + INTERVAL '1 day' AS window_end, count(*) AS error_count, "
    f"{level_of_sql('max(sev_rank)')} AS severity, coalesce(array_to_string(list_sort(list_distinct("
    "list(service) FILTER (WHERE service IS NOT NULL))), ','), '') AS affected_services, "
    "'Unpatterned error spike: ' || CAST(count(*) AS VARCHAR) || ' errors' AS title "
    "FROM entries WHERE severity IN ('ERROR', 'FATAL') GROUP BY session_name, date_trunc('day', timestamp) "
    f"HAVING count(*) >= {C.SPIKE_MIN_ERRORS}")
ORACLE["pattern_lifecycle"] = with_entries(
    "SELECT *, CASE WHEN active_since IS NULL THEN 'New' "
    f"WHEN epoch({AS_OF}) - epoch(last_seen) >= {C.RESOLVED_AFTER_S} THEN 'Resolved' "
    f"WHEN epoch(last_seen) - epoch(active_since) >= {C.RECURRING_AFTER_S} THEN 'Recurring' "
    "ELSE 'Active' END AS state FROM (SELECT session_name, signature, "
    f"min(CASE WHEN window_count >= {C.RECURRING_THRESHOLD} THEN timestamp END) AS active_since, "
    "max(timestamp) AS last_seen, count(*) AS occurrence_count FROM pw GROUP BY session_name, signature)",
    f"{SIG}, {PW}")
ORACLE["incident_patterns"] = with_entries(
    "SELECT i.id AS incident_id, i.session_name, i.signature, i.severity, i.status, "
    "coalesce(d.durable_rows, 0) AS durable_rows, d.first_durable, d.last_durable FROM inc i LEFT JOIN ("
    "SELECT session_name, signature, count(*) AS durable_rows, min(timestamp) AS first_durable, "
    "max(timestamp) AS last_durable FROM sig WHERE sev_rank >= 4 GROUP BY session_name, signature) d "
    "ON i.session_name = d.session_name AND i.signature = d.signature", INC_CTES)
ORACLE["session_stats"] = with_entries(
    "SELECT e.session_name, e.entries, e.errors, e.patterns, coalesce(i.n, 0) AS incidents, "
    "coalesce(a.n, 0) AS alerts FROM (SELECT session_name, count(*) AS entries, "
    "count_if(severity IN ('ERROR', 'FATAL')) AS errors, count(DISTINCT signature) AS patterns FROM sig "
    "GROUP BY session_name) e LEFT JOIN (SELECT session_name, count(*) AS n FROM inc GROUP BY session_name) i "
    "ON e.session_name = i.session_name LEFT JOIN (SELECT session_name, count(*) AS n FROM al "
    "GROUP BY session_name) a ON e.session_name = a.session_name",
    f"{SIG}, {FIRST}, {PW}, {PWF}, {TRIG}, {INCIDENTS}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, {ALERTS}")


# ---- step 7 ---------------------------------------------------------------
def simhash_ctes(src: str, id_col: str, text_col: str) -> str:
    ws = q(whitespace_class_regex())
    return (f"sh_docs AS (SELECT {id_col} AS sid, {normalize_sql(text_col, True)} AS norm FROM {src}), "
            f"sh_toks AS (SELECT sid, unnest(regexp_split_to_array(norm, {ws})) AS tok FROM sh_docs), "
            "sh_th AS (SELECT sid, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) AS th, "
            "CAST('0x' || substr(md5(tok), 9, 8) AS BIGINT) AS tl FROM sh_toks WHERE tok <> ''), "
            "sh_bits AS (SELECT sid, j, sum(((th >> j) & 1) * 2 - 1) AS sh, sum(((tl >> j) & 1) * 2 - 1) AS sl "
            "FROM sh_th CROSS JOIN (SELECT range AS j FROM range(32)) r GROUP BY sid, j), "
            "codes AS (SELECT d.sid, CAST(coalesce(sum(CASE WHEN sh > 0 THEN CAST(1 AS BIGINT) << j END), 0) "
            "AS BIGINT) AS hi, CAST(coalesce(sum(CASE WHEN sl > 0 THEN CAST(1 AS BIGINT) << j END), 0) AS BIGINT) "
            "AS lo FROM sh_docs d LEFT JOIN sh_bits b ON d.sid = b.sid GROUP BY d.sid)")


DOC_CODES = simhash_ctes("documents", "doc_id", "text")
ORACLE["simhash_codes"] = f"WITH {DOC_CODES} SELECT sid AS doc_id, hi, lo FROM codes"
ORACLE["near_dup_pairs"] = (
    f"WITH {DOC_CODES}, dh AS (SELECT DISTINCT hi, lo FROM codes) "
    "SELECT * FROM (SELECT a.hi AS a_hi, a.lo AS a_lo, b.hi AS b_hi, b.lo AS b_lo, "
    "CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance "
    "FROM dh a JOIN dh b ON a.hi < b.hi OR (a.hi = b.hi AND a.lo < b.lo)) WHERE distance <= 3")


# ---- step 8 ---------------------------------------------------------------
SUMMARY_START = ts(C.SUMMARY_START)
LEVEL_COUNTS = ", ".join(f"count_if(severity = {q(lv)}) AS n_{lv.lower()}" for lv in
                         ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN"])
SERVICES_TEXT = ("coalesce(array_to_string(list_sort(list_distinct(list(service) FILTER "
                 "(WHERE service IS NOT NULL))), ','), '')")
ORACLE["window_summary"] = with_entries(
    "SELECT c.*, coalesce(v.services, 0) AS services, v.services_by_count, coalesce(p.patterns, 0) AS patterns, "
    "p.top_patterns, coalesce(i.n, 0) AS active_incidents, coalesce(a.n, 0) AS active_alerts FROM "
    f"(SELECT session_name, {LEVEL_COUNTS}, count(*) AS total FROM win GROUP BY session_name) c "
    "LEFT JOIN (SELECT session_name, count(*) AS services, string_agg(service || ':' || n, ',' ORDER BY n DESC, service) AS services_by_count "
    "FROM (SELECT session_name, service, count(*) AS n FROM win WHERE service IS NOT NULL "
    "GROUP BY session_name, service) GROUP BY session_name) v ON c.session_name = v.session_name "
    "LEFT JOIN (SELECT session_name, count(*) AS patterns, string_agg(signature || ':' || occ, ',' ORDER BY r) "
    "FILTER (r <= 10) AS top_patterns FROM (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY occ DESC, "
    "first_seen, signature) AS r FROM (SELECT session_name, signature, count(*) AS occ, min(timestamp) AS first_seen "
    "FROM win GROUP BY session_name, signature)) GROUP BY session_name) p ON c.session_name = p.session_name "
    "LEFT JOIN (SELECT session_name, count(*) AS n FROM inc WHERE status = 'Active' GROUP BY session_name) i "
    "ON c.session_name = i.session_name LEFT JOIN (SELECT session_name, count(*) AS n FROM al "
    "WHERE status = 'Active' GROUP BY session_name) a ON c.session_name = a.session_name",
    f"{SIG}, {FIRST}, {PW}, {PWF}, {TRIG}, {INCIDENTS}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, "
    f"{ALERTS}, win AS (SELECT * FROM sig WHERE timestamp >= {SUMMARY_START})")
ORACLE["incident_digest"] = with_entries(
    "SELECT h.session_name, rank, id, timestamp, severity, raw_content, greatest(total - 50, 0) AS omitted, "
    "error_count, fatal_count, services FROM (SELECT *, row_number() OVER (PARTITION BY session_name "
    "ORDER BY timestamp DESC, pane_id, sequence) AS rank FROM f) h JOIN (SELECT session_name, "
    "count_if(severity = 'ERROR') AS error_count, count_if(severity = 'FATAL') AS fatal_count, "
    f"{SERVICES_TEXT} AS services, count(*) AS total FROM f GROUP BY session_name) st "
    "ON h.session_name = st.session_name WHERE rank <= 50",
    f"f AS (SELECT * FROM entries WHERE timestamp >= {ts(C.DIGEST_SINCE)} AND sev_rank BETWEEN 4 AND 5)")
B = C.TOKEN_BUDGET
ORACLE["token_budget"] = (
    "SELECT conv_id, turn, role, tokens, cum_tokens, NOT fits AS truncated, CASE WHEN fits THEN text ELSE "
    f"left(text, list_max([c for c in range(0, length(text) + 1) if strlen(left(text, c)) <= ({B} - prev_tokens) * 4])) "
    "|| chr(10) || chr(10) || "
    "'[Output truncated due to token limit]' END AS context_text FROM (SELECT *, "
    f"cum_tokens <= {B} AS fits, cum_tokens - tokens AS prev_tokens FROM (SELECT *, (strlen(text) + 3) // 4 AS tokens, "
    "CAST(sum((strlen(text) + 3) // 4) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) "
    f"AS BIGINT) AS cum_tokens FROM conversations)) WHERE fits OR prev_tokens < {B}")
LIVENESS = (
    "live AS (SELECT session_name, pane_id, last_seen, CASE WHEN idle_seconds <= "
    f"{C.STALE_AFTER_S} THEN 0 WHEN idle_seconds <= {C.DISCONNECT_AFTER_S} THEN 1 ELSE 2 END AS o FROM ("
    f"SELECT session_name, pane_id, max(received_at) AS last_seen, epoch({AS_OF}) - epoch(max(received_at)) "
    "AS idle_seconds FROM entries GROUP BY session_name, pane_id))")
STATS = (
    "stats AS (SELECT e.session_name, e.entries, e.errors, e.patterns, coalesce(i.n, 0) AS incidents, "
    "coalesce(a.n, 0) AS alerts FROM (SELECT session_name, count(*) AS entries, "
    "count_if(severity IN ('ERROR', 'FATAL')) AS errors, count(DISTINCT signature) AS patterns FROM sig "
    "GROUP BY session_name) e LEFT JOIN (SELECT session_name, count(*) AS n FROM inc GROUP BY session_name) i "
    "ON e.session_name = i.session_name LEFT JOIN (SELECT session_name, count(*) AS n FROM al "
    "GROUP BY session_name) a ON e.session_name = a.session_name)")
ORACLE["status_overview"] = with_entries(
    "SELECT l.session_name, (['Active', 'Stale', 'Disconnected'])[max(o) + 1] AS status, count(*) AS panes, "
    "max(last_seen) AS last_seen, any_value(s.entries) AS entries, any_value(s.errors) AS errors, "
    "any_value(s.patterns) AS patterns, any_value(s.incidents) AS incidents, any_value(s.alerts) AS alerts "
    "FROM live l JOIN stats s ON l.session_name = s.session_name GROUP BY l.session_name",
    f"{SIG}, {FIRST}, {PW}, {PWF}, {TRIG}, {INCIDENTS}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, "
    f"{ALERTS}, {LIVENESS}, {STATS}")
ORACLE["quick_summary"] = with_entries(
    "SELECT session_name, rate_key, arg_max(rate, (timestamp, pane_id, sequence)) AS current_rate "
    "FROM rates GROUP BY session_name, rate_key", RATES)

# ---- step 9 ---------------------------------------------------------------


def _custom_sql() -> str:
    import re
    idx_parts, field_parts = [], {f: [] for f in ("timestamp", "level", "severity", "service", "message")}
    for i, p in enumerate(C.CUSTOM_PATTERNS):
        groups = re.compile(p).groupindex
        idx_parts.append(f"WHEN regexp_matches(raw_content, {q(p)}) THEN {i}")
        for f in field_parts:
            if f in groups:
                field_parts[f].append(f"WHEN {i} THEN regexp_extract(raw_content, {q(p)}, {groups[f]})")
    cols = ", ".join(
        (f"CASE pattern_index {' '.join(v)} END AS {f}" if v else f"CAST(NULL AS VARCHAR) AS {f}")
        for f, v in field_parts.items())
    return (f"SELECT id, pattern_index, {cols} FROM (SELECT *, CASE {' '.join(idx_parts)} END AS pattern_index "
            "FROM entries) WHERE pattern_index IS NOT NULL")


ORACLE["custom_patterns"] = with_entries(_custom_sql())
ORACLE["collapse_multiline"] = with_entries(
    "SELECT session_name, pane_id, group_start, arg_min(id, sequence) AS id, min(timestamp) AS timestamp, "
    "count(*) AS line_count, max(sequence) AS last_sequence, string_agg(raw_content, chr(10) ORDER BY sequence) "
    "AS content FROM (SELECT *, coalesce(max(CASE WHEN regexp_matches(raw_content, "
    f"{q(C.MULTILINE_START)}) THEN sequence END) OVER (PARTITION BY pane_id ORDER BY sequence "
    "ROWS UNBOUNDED PRECEDING), sequence) AS group_start FROM entries) "
    "GROUP BY session_name, pane_id, group_start")
ORACLE["validate_entries"] = with_entries(
    "SELECT a.id, a.session_name, a.pane_id, a.sequence, "
    "a.timestamp > a.received_at + INTERVAL '5 seconds' AS future_skew, "
    "coalesce(b.received_at > a.received_at, false) AS sequence_regression, "
    "strlen(a.raw_content) > 10240 AS oversize, CASE WHEN strlen(a.raw_content) > 10240 THEN "
    "substr(a.raw_content, 1, 10240) || '...[truncated]' ELSE a.raw_content END AS content "
    "FROM entries a LEFT JOIN entries b ON a.pane_id = b.pane_id AND b.sequence = a.sequence - 1")
ORACLE["prefix_signature"] = with_entries(
    "SELECT id, severity || ':' || substr(lower(trim(regexp_replace(raw_content, '\\s', ' ', 'g'))), 1, 100) "
    "AS prefix_signature FROM entries")
ORACLE["source_preview"] = with_entries(
    "SELECT id, coalesce(service, 'pane:' || substr(pane_id, 1, 8)) AS source, substr(raw_content, 1, 120) "
    "AS preview FROM entries")

# ---- durable store and upserts ----------------------------------------------
ORACLE["durable_range"] = with_entries(
    f"SELECT id, session_name, severity, timestamp FROM entries WHERE sev_rank >= 4 AND timestamp >= {ts(C.PAGE_SINCE)} "
    f"AND timestamp <= {ts(C.PAGE_UNTIL)}")
ORACLE["durable_purge"] = with_entries(
    "SELECT session_name, count(*) AS kept, min(timestamp) AS oldest FROM entries WHERE sev_rank >= 4 "
    f"AND timestamp >= {ts(C.DURABLE_SINCE)} GROUP BY session_name")
ORACLE["upsert_latest"] = with_entries(
    "SELECT session_name || '/' || coalesce(service, '-') AS id, arg_max(id, (timestamp, id)) AS entry_id, "
    "max(timestamp) AS updated_at FROM entries GROUP BY session_name || '/' || coalesce(service, '-')")

# ---- further filters, sessions, lifecycles ------------------------------------
ORACLE["first_matches"] = with_entries(
    f"SELECT id, pane_id, sequence, kw AS detected_severity FROM (SELECT *, {KW} AS kw FROM entries) "
    f"WHERE {rank_case('kw')} >= 4 ORDER BY pane_id, sequence LIMIT {C.FILTER_LIMIT}")
ORACLE["pane_level"] = with_entries(
    f"SELECT id, session_name, sequence, timestamp FROM entries WHERE severity = 'ERROR' AND pane_id = {q(C.FILTER_PANE)}")
ORACLE["severe_services"] = with_entries(
    "SELECT session_name, count_if(severity = 'ERROR') AS error_count, count_if(severity = 'FATAL') AS fatal_count, "
    "array_to_string(list_sort(list_distinct(list(service) FILTER (WHERE service IS NOT NULL))), ',') AS services "
    "FROM entries WHERE severity IN ('ERROR', 'FATAL') GROUP BY session_name")
ORACLE["session_list"] = with_entries(
    "SELECT session_name, array_to_string(list_sort(list_distinct(list(pane_id))), ',') AS pane_ids, "
    "min(received_at) AS created_at, max(received_at) AS last_seen FROM entries GROUP BY session_name")
ORACLE["fresh_entries"] = with_entries(
    "SELECT id, session_name FROM entries WHERE session_name IN (SELECT session_name FROM entries "
    f"GROUP BY session_name HAVING epoch({AS_OF}) - epoch(max(received_at)) <= {C.STALE_AFTER_S})")
ORACLE["severity_order"] = with_entries(
    "SELECT session_name, row_number() OVER (PARTITION BY session_name ORDER BY n DESC, r) AS position, severity, "
    "n AS entry_count FROM (SELECT session_name, severity, count(*) AS n, min(sev_rank) AS r FROM entries "
    "GROUP BY session_name, severity)")
LOOP_AS_OF = ts(C.LOOP_AS_OF)
ORACLE["looping_services"] = with_entries(
    "SELECT session_name, restart_service, window_start, n AS transitions FROM (SELECT session_name, restart_service, "
    "arg_max(window_start, (timestamp, pane_id, sequence)) AS window_start, "
    "arg_max(window_count, (timestamp, pane_id, sequence)) AS n FROM lw GROUP BY session_name, restart_service) "
    f"WHERE n >= 2 AND epoch({LOOP_AS_OF}) - epoch(window_start) < {C.RESTART_WINDOW_S}",
    f"{TRANS}, past AS (SELECT * FROM trans WHERE timestamp <= {LOOP_AS_OF}), "
    + anchored_sql("lw", "past", ["session_name", "restart_service"], "timestamp", ["pane_id", "sequence"],
                   C.RESTART_WINDOW_S))
ORACLE["pattern_spikes"] = with_entries(
    f"SELECT session_name, signature, window_start, max(window_count) AS window_count, max(window_count) >= "
    f"{C.PATTERN_SPIKE} AS is_spike FROM pw GROUP BY session_name, signature, window_start", f"{SIG}, {PW}")

# a silent incident resolves; then the last action of a person counts
INC_LIFE = (
    f"{INC_CTES}, quiet AS (SELECT session_name, signature, max(timestamp) AS last_trigger FROM trig "
    "GROUP BY session_name, signature), "
    "life AS (SELECT i.* EXCLUDE (status), CASE WHEN d BETWEEN '4' AND '9' THEN 'Resolved' WHEN d <= '7' THEN 'Mitigating' "
    "WHEN done THEN 'Resolved' ELSE 'Active' END AS status, CASE WHEN d BETWEEN '4' AND '9' THEN started_at + INTERVAL 2 DAY "
    f"WHEN done THEN last_trigger + INTERVAL '{C.AUTO_RESOLVE_S} seconds' END AS resolved_at FROM (SELECT inc.*, "
    f"last_trigger, substr(id, 1, 1) AS d, epoch({AS_OF}) - epoch(last_trigger) > {C.AUTO_RESOLVE_S} AS done "
    "FROM inc JOIN quiet USING (session_name, signature)) i)")
ORACLE["incident_lifecycle"] = with_entries(
    "SELECT id, session_name, signature, status, resolved_at FROM life", INC_LIFE)
ORACLE["service_incidents"] = with_entries(
    "SELECT id, session_name, title, severity, status, started_at, entry_count, signature, affected_services, "
    "pattern_count FROM life WHERE status = 'Active' AND "
    f"list_contains(string_split(affected_services, ','), {q(C.AFFECTED_SERVICE)})", INC_LIFE)
ORACLE["alert_actions"] = with_entries(
    "SELECT md5(session_name || '|' || alert_type || '|' || k || '|' || strftime(triggered_at, '%Y-%m-%d %H:%M:%S.%f')) "
    "AS id, session_name, alert_type, pattern_id, current_value, triggered_at, CASE WHEN acked THEN ack END AS "
    "acknowledged_at, CASE WHEN res IS NOT NULL THEN 'Resolved' WHEN acked THEN 'Acknowledged' ELSE 'Active' END AS status, "
    "trigger_count FROM (SELECT *, ack IS NOT NULL AND (res IS NULL OR ack < res) AS acked FROM seen)",
    f"{SIG}, {FIRST}, {PW}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, "
    "opened AS (SELECT session_name, alert_type, k, min(timestamp) AS t0, "
    "substr(md5(session_name || '|' || alert_type || '|' || k), 1, 1) AS d FROM trig_all GROUP BY ALL), "
    "acted AS (SELECT t.*, CASE WHEN d <= '7' THEN t0 + INTERVAL 1 DAY END AS a1, "
    "CASE WHEN d BETWEEN '4' AND 'b' THEN t0 + INTERVAL 3 DAY END AS a2 FROM trig_all t JOIN opened o "
    "ON t.session_name = o.session_name AND t.alert_type = o.alert_type AND t.k = o.k), "
    "runs AS (SELECT session_name, alert_type, k, coalesce(CAST(a1 <= timestamp AS INTEGER), 0) + "
    "coalesce(CAST(a2 <= timestamp AS INTEGER), 0) AS ep, any_value(a1) AS a1, any_value(a2) AS a2, "
    "min(timestamp) AS triggered_at, arg_min(pattern_id, (timestamp, pane_id, sequence)) AS pattern_id, "
    "arg_max(value, (timestamp, pane_id, sequence)) AS current_value, count(*) AS trigger_count FROM acted "
    "GROUP BY session_name, alert_type, k, ep), "
    "nexts AS (SELECT *, lead(triggered_at) OVER (PARTITION BY session_name, alert_type, k ORDER BY ep) AS nx FROM runs), "
    "seen AS (SELECT *, CASE WHEN a1 >= triggered_at AND (nx IS NULL OR a1 < nx) THEN a1 END AS ack, "
    "CASE WHEN a2 >= triggered_at AND (nx IS NULL OR a2 < nx) THEN a2 END AS res FROM nexts)")


# ---- greedy leader clusters (the sequential rule, one hash a step) ---------------
def greedy_ctes(src: str, scope: str, rank: str, member: str) -> str:
    """``lh``: distinct hashes of ``src`` with first and last member; ``led``:
    each with its leader.  A step of the recursion takes the next hash of a
    scope that has any neighbour and adds it to the scope's list of leaders
    unless one of them is within three bits."""
    near = "bit_count(xor({0}.hi, {1}.hi)) + bit_count(xor({0}.lo, {1}.lo)) <= 3"
    return (
        f"lh AS MATERIALIZED (SELECT {scope} AS scope, hi, lo, min({rank}) AS rank, arg_min({member}, {rank}) AS first_member, "
        f"max({rank}) AS last_rank, arg_max({member}, {rank}) AS last_member, count(*) AS members FROM {src} GROUP BY ALL), "
        "nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY rank) AS k FROM lh a WHERE EXISTS "
        f"(SELECT 1 FROM lh b WHERE a.scope = b.scope AND (a.hi <> b.hi OR a.lo <> b.lo) AND {near.format('a', 'b')})), "
        "grow(scope, k, leaders) AS (SELECT DISTINCT scope, CAST(0 AS BIGINT), CAST([] AS STRUCT(hi BIGINT, lo BIGINT)[]) "
        "FROM nn UNION ALL SELECT g.scope, n.k, CASE WHEN len(list_filter(g.leaders, lambda l: "
        f"{near.format('l', 'n')})) > 0 THEN g.leaders ELSE list_append(g.leaders, {{'hi': n.hi, 'lo': n.lo}}) END "
        "FROM grow g JOIN nn n ON n.scope = g.scope AND n.k = g.k + 1), "
        "led AS MATERIALIZED (SELECT lh.*, coalesce(l.leader, {'hi': lh.hi, 'lo': lh.lo}) AS leader FROM lh LEFT JOIN ("
        f"SELECT n.scope, n.hi, n.lo, list_filter(g.leaders, lambda l: {near.format('l', 'n')})[1] AS leader "
        "FROM nn n JOIN (SELECT scope, arg_max(leaders, k) AS leaders FROM grow GROUP BY scope) g ON g.scope = n.scope) l "
        "ON l.scope = lh.scope AND l.hi = lh.hi AND l.lo = lh.lo)")


ORACLE["leader_clusters"] = (
    f"WITH RECURSIVE {DOC_CODES}, {greedy_ctes('codes', '0', 'sid', 'sid')} "
    "SELECT a.hi, a.lo, a.first_member AS first_doc, a.members, a.leader.hi = a.hi AND a.leader.lo = a.lo AS is_leader, "
    "a.leader.hi AS leader_hi, a.leader.lo AS leader_lo, b.first_member AS leader_doc FROM led a JOIN lh b "
    "ON a.leader.hi = b.hi AND a.leader.lo = b.lo")
LINE_CODES = (f"{SIG}, {simhash_ctes('entries', 'id', 'raw_content')}, coded AS (SELECT sig.*, hi, lo FROM sig JOIN codes "
              "ON codes.sid = sig.id)")
LINE_CLUSTERS = (
    f"{LINE_CODES}, {greedy_ctes('coded', 'session_name', '(timestamp, pane_id, sequence)', 'id')}, "
    "lines AS (SELECT scope AS session_name, leader.hi AS leader_hi, leader.lo AS leader_lo, "
    "arg_min(first_member, rank) AS representative, arg_max(last_member, last_rank) AS last_member, "
    "CAST(sum(members) AS BIGINT) AS members, count(*) AS distinct_hashes FROM led GROUP BY ALL)")
ORACLE["dedup_lines"] = with_entries("SELECT * FROM lines", LINE_CLUSTERS)
ORACLE["recent_clusters"] = with_entries(
    "SELECT session_name, last_seen, last_member, representative, members FROM (SELECT *, row_number() OVER ("
    "PARTITION BY session_name ORDER BY last_seen DESC, last_member, representative, members) AS r FROM "
    "(SELECT c.session_name, e.timestamp AS last_seen, c.last_member, c.representative, c.members FROM lines c "
    f"JOIN entries e ON e.id = c.last_member)) WHERE r <= {C.CLUSTER_LIMIT}", LINE_CLUSTERS)
ORACLE["cluster_totals"] = with_entries(
    "SELECT c.session_name, total_clusters, active_patterns FROM (SELECT session_name, count(*) AS total_clusters "
    "FROM lines GROUP BY session_name) c FULL JOIN (SELECT session_name, count(*) AS active_patterns FROM (SELECT "
    f"session_name, min(CASE WHEN window_count >= {C.RECURRING_THRESHOLD} THEN timestamp END) AS since, "
    "max(timestamp) AS last_seen FROM pw GROUP BY session_name, signature) WHERE since IS NULL OR "
    f"epoch({AS_OF}) - epoch(last_seen) < {C.RESOLVED_AFTER_S} GROUP BY session_name) p "
    "ON c.session_name = p.session_name", f"{LINE_CLUSTERS}, {PW}")
# the signature of a line is that of its cluster's first line
BY_CLUSTER = (
    f"{LINE_CODES.replace('sig AS', 'own AS', 1).replace('FROM sig JOIN', 'FROM own JOIN').replace('sig.', 'own.')}, "
    f"{greedy_ctes('coded', 'session_name', '(timestamp, pane_id, sequence)', 'signature')}, "
    "sig AS MATERIALIZED (SELECT c.* EXCLUDE (signature), b.first_member AS signature FROM coded c JOIN led a "
    "ON a.scope = c.session_name AND a.hi = c.hi AND a.lo = c.lo JOIN lh b ON b.scope = a.scope "
    "AND b.hi = a.leader.hi AND b.lo = a.leader.lo)")
ORACLE["cluster_recurring"] = ORACLE["recurring_errors"].replace(SIG, BY_CLUSTER)
ORACLE["cluster_incidents"] = ORACLE["incidents"].replace(SIG, BY_CLUSTER)
ORACLE["cluster_alerts"] = ORACLE["alerts"].replace(SIG, BY_CLUSTER)


# ---- restarted captures ---------------------------------------------------------
def restarted(name: str) -> str:
    """A query's SQL over the lines of restarted captures."""
    return ORACLE[name].replace(LOG_LINES_CTE, RESTARTED_CTE)


ARRIVED = ("arrived AS (SELECT *, row_number() OVER (PARTITION BY session_name, pane_id ORDER BY received_at, sequence, "
           "raw_content) AS pos FROM entries)")
ORACLE["restarted_parse"] = restarted("parse_entries")
ORACLE["restarted_collapse"] = with_entries(
    "SELECT session_name, pane_id, arg_min(sequence, pos) AS group_start, arg_min(id, pos) AS id, min(timestamp) AS "
    "timestamp, count(*) AS line_count, arg_max(sequence, pos) AS last_sequence, string_agg(raw_content, chr(10) "
    "ORDER BY pos) AS content FROM (SELECT *, coalesce(max(CASE WHEN NOT regexp_matches(raw_content, "
    "'^(\\s|at |Caused by:|\\.\\.\\. \\d+ more)') THEN pos END) OVER (PARTITION BY session_name, pane_id ORDER BY pos "
    "ROWS UNBOUNDED PRECEDING), pos) AS grp FROM arrived) GROUP BY session_name, pane_id, grp", ARRIVED, RESTARTED_CTE)
ORACLE["restarted_retention"] = with_entries(
    "SELECT a.id, a.session_name, a.pane_id, a.sequence FROM arrived a JOIN (SELECT session_name, pane_id, min(pos) AS k "
    f"FROM arrived WHERE timestamp >= {AS_OF} - INTERVAL '{C.RETENTION_S} seconds' GROUP BY ALL) t "
    "ON a.session_name = t.session_name AND a.pane_id = t.pane_id WHERE a.pos >= t.k", ARRIVED, RESTARTED_CTE)
ORACLE["restarted_liveness"] = with_entries(
    "SELECT session_name, pane_id, lines, last_seen, stale_gaps, disconnect_gaps, idle_seconds, "
    f"CASE WHEN idle_seconds <= {C.STALE_AFTER_S} THEN 'Active' WHEN idle_seconds <= {C.DISCONNECT_AFTER_S} THEN 'Stale' "
    "ELSE 'Disconnected' END AS status FROM (SELECT session_name, pane_id, count(*) AS lines, max(received_at) AS last_seen, "
    f"count_if(gap > {C.STALE_AFTER_S}) AS stale_gaps, count_if(gap > {C.DISCONNECT_AFTER_S}) AS disconnect_gaps, "
    f"epoch({AS_OF}) - epoch(max(received_at)) AS idle_seconds FROM (SELECT *, epoch(received_at) - epoch(lag(received_at) "
    "OVER (PARTITION BY session_name, pane_id ORDER BY received_at)) AS gap FROM entries) GROUP BY session_name, pane_id)",
    "", RESTARTED_CTE)
ORACLE["restarted_fresh"] = with_entries(
    "SELECT session_name, count(*) AS lines FROM entries GROUP BY session_name HAVING "
    f"epoch({AS_OF}) - epoch(max(received_at)) <= {C.STALE_SESSION_S}", "", RESTARTED_CTE)
ORACLE["restarted_cycle"] = restarted("restart_cycle").replace(
    f"epoch(t3) <= {C.RESTART_WINDOW_S}", f"epoch(t3) <= {C.CYCLE_WINDOW_S}")
ORACLE["restarted_error_rate"] = restarted("error_rate")
ORACLE["restarted_incidents"] = restarted("incidents")
ORACLE["restarted_alerts"] = restarted("alerts")
ORACLE["restarted_samples"] = restarted("pattern_sample")

# ---- leaders of bounded life, one line a step --------------------------------------
LIVES = (
    f"{LINE_CODES}, step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_name ORDER BY timestamp, pane_id, "
    "sequence) AS k FROM coded), "
    "life(session_name, k, leaders, lead) AS (SELECT DISTINCT session_name, CAST(0 AS BIGINT), "
    "CAST([] AS STRUCT(hi BIGINT, lo BIGINT, t TIMESTAMP)[]), CAST(NULL AS STRUCT(hi BIGINT, lo BIGINT, t TIMESTAMP)) FROM step "
    "UNION ALL SELECT session_name, k, CASE WHEN found IS NULL THEN list_append(alive, me) ELSE alive END, coalesce(found, me) "
    "FROM (SELECT *, list_filter(alive, lambda l: bit_count(xor(l.hi, me.hi)) + bit_count(xor(l.lo, me.lo)) <= 3)[1] AS found "
    "FROM (SELECT n.session_name, n.k, {'hi': n.hi, 'lo': n.lo, 't': n.timestamp} AS me, list_filter(g.leaders, lambda l: "
    f"l.t >= n.timestamp - INTERVAL '{C.LEADER_TTL_S} seconds') AS alive FROM life g JOIN step n "
    "ON n.session_name = g.session_name AND n.k = g.k + 1)))")
ORACLE["leader_clusters_ttl"] = with_entries(
    "SELECT s.session_name, l.lead.hi AS leader_hi, l.lead.lo AS leader_lo, l.lead.t AS led_at, arg_min(s.id, s.k) AS representative, "
    "arg_max(s.id, s.k) AS last_member, count(*) AS members, count(DISTINCT (s.hi, s.lo)) AS distinct_hashes FROM step s JOIN life l "
    "ON s.session_name = l.session_name AND s.k = l.k GROUP BY ALL", LIVES)
ORACLE["context_selection"] = with_entries(
    "SELECT session_name, \"position\", kind, item_id, \"at\", tokens, cum_tokens, text FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY "
    "session_name ORDER BY \"position\" ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_tokens FROM (SELECT *, row_number() OVER ("
    "PARTITION BY session_name ORDER BY priority, r DESC, \"at\" DESC, item_id, text) AS \"position\", "
    "greatest((strlen(text) + 3) // 4, 1) AS tokens FROM ("
    f"SELECT session_name, 'incident' AS kind, 1 AS priority, {rank_case('severity')} AS r, started_at AS \"at\", id AS item_id, "
    "'[' || severity || '] ' || title AS text FROM inc WHERE status = 'Active' UNION ALL "
    f"SELECT session_name, 'pattern', 2, {rank_case('severity')}, last_seen, signature, '[' || severity || '] ' || "
    "CAST(occurrence_count AS VARCHAR) || ' occurrences, sample ' || sample_entry FROM rollup UNION ALL "
    "SELECT session_name, 'entry', 3, sev_rank, timestamp, id, '[' || severity || '] ' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') "
    f"|| ' ' || coalesce(service, '-') FROM entries))) WHERE cum_tokens <= {C.CONTEXT_BUDGET}",
    f"{INC_CTES}, {FIRST}, {ROLLUP}")

# ---- streams: what the batch queries give -------------------------------------------
SQ = C.stream_catalog
ORACLE["stream_follow"] = ORACLE["line_filter"]
ORACLE["stream_durable"] = with_entries("SELECT id, session_name, severity, timestamp FROM entries WHERE sev_rank >= 4")
ORACLE["stream_error_rate"] = with_entries(
    "SELECT session_name, coalesce(service, '_global') AS rate_key, s AS window_start, s + INTERVAL '1 day' AS window_end, "
    "count(*) AS errors FROM (SELECT *, time_bucket(INTERVAL '6 hours', timestamp) - k * INTERVAL '6 hours' AS s FROM entries "
    "CROSS JOIN (SELECT unnest(range(4)) AS k) WHERE sev_rank >= 4) WHERE s + INTERVAL '1 day' <= "
    "(SELECT max(timestamp) FROM entries) - INTERVAL '1 hour' GROUP BY ALL")
_LIFE = anchored_sql("l0", "sig", ["session_name", "signature"], "timestamp", ["pane_id", "sequence"], SQ.PATTERN_TTL_S)
_INLIFE = anchored_sql("l2", "l1", ["session_name", "signature", "life"], "timestamp", ["pane_id", "sequence"], C.PATTERN_WINDOW_S)
ORACLE["stream_patterns"] = with_entries(
    "SELECT id, session_name, signature, window_start, window_count, occ AS occurrence_count, occ = 1 AS is_first FROM ("
    "SELECT *, row_number() OVER (PARTITION BY session_name, signature, life ORDER BY timestamp, pane_id, sequence) AS occ FROM l2)",
    f"{SIG}, {_LIFE}, l1 AS (SELECT * EXCLUDE (window_start, window_count), window_start AS life FROM l0), {_INLIFE}")
ORACLE["stream_clusters"] = ORACLE["dedup_lines"]
ORACLE["stream_alerts"] = (ORACLE["alert_actions"]
    .replace("THEN t0 + INTERVAL 1 DAY", f"THEN {ts(SQ.ACK_AT)}").replace("THEN t0 + INTERVAL 3 DAY", f"THEN {ts(SQ.RESOLVE_AT)}")
    .replace("arg_max(value, (timestamp, pane_id, sequence)) AS current_value, count(*) AS trigger_count FROM acted",
             "arg_max(value, (timestamp, pane_id, sequence)) AS current_value, count(*) AS trigger_count, "
             "arg_min(message, (timestamp, pane_id, sequence)) AS message, arg_min(severity, (timestamp, pane_id, sequence)) AS "
             "severity, any_value(threshold) AS threshold FROM acted")
    .replace("END AS status, trigger_count FROM", "END AS status, trigger_count, message, severity, threshold FROM"))

# ---- stored tables merged by batches ---------------------------------------------------
ORACLE["upsert_store"] = ORACLE["upsert_latest"]
ORACLE["pattern_store"] = ORACLE["pattern_rollup"]
ORACLE["new_patterns"] = with_entries(
    "SELECT session_name, signature, CASE WHEN min(timestamp) < TIMESTAMP '2024-01-11' THEN 0 WHEN min(timestamp) < "
    "TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS batch FROM sig GROUP BY session_name, signature", SIG)


# ---- documents, services, panes ----------------------------------------------------------
def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%fZ')"


def document_sql(src: str, name: str, order: str, fields: str, offset: int = 0, echo: str = "") -> str:
    return (f"SELECT session_name, CAST(to_json({{'session_name': session_name, 'total': total, 'offset': {offset}, 'limit': "
            f"{C.DOCUMENT_LIMIT}, {echo}'{name}': rows}}) AS VARCHAR) AS document FROM (SELECT session_name, any_value(n) AS total, "
            f"list({{{fields}}} ORDER BY rn) AS rows FROM (SELECT *, count(*) OVER (PARTITION BY session_name) AS n, row_number() "
            f"OVER (PARTITION BY session_name ORDER BY {order}) AS rn FROM {src}) WHERE rn > {offset} AND rn <= "
            f"{offset + C.DOCUMENT_LIMIT} GROUP BY session_name)")


_ERR, _SVC = q(C.PAGE_SEVERITY), q(C.AFFECTED_SERVICE)
ORACLE["entries_document"] = with_entries(
    document_sql("f", "entries", "timestamp, pane_id, sequence",
                 f"'id': id, 'timestamp': {iso('timestamp')}, 'severity': severity, 'service': service, 'raw_content': raw_content", 2,
                 f"'filters': {{'since': '{C.PAGE_SINCE:%Y-%m-%dT%H:%M:%SZ}', 'severity': {_ERR}, 'service': {_SVC}}}, "),
    f"f AS (SELECT * FROM entries WHERE timestamp >= {ts(C.PAGE_SINCE)} AND severity = upper({_ERR}) AND service = {_SVC})")
ORACLE["patterns_document"] = with_entries(
    document_sql("rollup", "patterns", "occurrence_count DESC, first_seen, signature",
                 "'signature': signature, 'severity': severity, 'occurrence_count': occurrence_count, "
                 f"'first_seen': {iso('first_seen')}, 'last_seen': {iso('last_seen')}, 'sample_entry': sample_entry"),
    f"{SIG}, {FIRST}, {ROLLUP}")
ORACLE["incidents_document"] = with_entries(
    document_sql("life", "incidents", "started_at DESC, id",
                 f"'id': id, 'title': title, 'severity': severity, 'status': status, 'started_at': {iso('started_at')}, "
                 f"'resolved_at': {iso('resolved_at')}, 'affected_services': CASE WHEN affected_services = '' THEN [] ELSE "
                 "string_split(affected_services, ',') END, 'pattern_count': pattern_count"), INC_LIFE)
ORACLE["alerts_document"] = with_entries(
    document_sql("al", "alerts", "triggered_at DESC, id",
                 f"'id': id, 'type': alert_type, 'triggered_at': {iso('triggered_at')}, 'status': status, 'message': message, "
                 "'threshold': threshold, 'current_value': current_value"), ALERT_CTES)
ORACLE["service_level"] = with_entries(
    f"SELECT id, session_name, timestamp, severity, service FROM entries WHERE severity = 'WARN' AND service = {_SVC}")
ORACLE["search_severity"] = with_entries(
    "SELECT session_name, rank, id, pane_id, sequence, line FROM (SELECT session_name, row_number() OVER (PARTITION BY "
    "session_name ORDER BY pane_id, sequence) AS rank, id, pane_id, sequence, '[' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') "
    f"|| '] ' || raw_content AS line FROM entries WHERE contains(raw_content, {q(C.SEARCH_NEEDLE)}) AND severity = upper({_ERR})) "
    "WHERE rank <= 50")
ORACLE["durable_pane"] = with_entries(
    f"SELECT id, session_name, sequence, severity FROM entries WHERE sev_rank >= 4 AND pane_id = {q(C.FILTER_PANE)}")
ORACLE["durable_session"] = with_entries(
    f"SELECT id, pane_id, timestamp FROM entries WHERE severity = 'FATAL' AND session_name = 'sess-1' AND timestamp >= "
    f"{ts(C.PAGE_SINCE)} AND timestamp <= {ts(C.PAGE_UNTIL)}")
ORACLE["errors_summary"] = with_entries(
    f"SELECT session_name, count(*) AS total, count_if(severity = 'FATAL') AS n_fatal, {SERVICES_TEXT} AS services, "
    f"max(timestamp) AS last_seen FROM entries WHERE severity IN ('ERROR', 'FATAL') AND timestamp >= {SUMMARY_START} "
    "GROUP BY session_name")

# ---- panes on a stream: what the watermark (an hour behind, whole milliseconds) has closed ------------
MARK = "mark AS (SELECT epoch_ms(max(received_at)) - 3600000 AS wm FROM entries)"


def _due(us: str) -> str:
    return f"({us}) // 1000 + 1 <= (SELECT wm FROM mark)"


_PANE_ORDER = "PARTITION BY session_name, pane_id ORDER BY received_at, sequence, raw_content"
ORACLE["stream_collapse"] = with_entries(
    "SELECT session_name, pane_id, arg_min(sequence, pos) AS group_start, arg_min(id, pos) AS id, min(timestamp) AS timestamp, "
    "count(*) AS line_count, arg_max(sequence, pos) AS last_sequence, string_agg(raw_content, chr(10) ORDER BY pos) AS content "
    "FROM grouped GROUP BY session_name, pane_id, grp HAVING max(grp) < any_value(last_grp) OR "
    f"{_due(f'epoch_us(max(received_at)) + {SQ.SILENCE_S}000000')}",
    f"{MARK}, gapped AS (SELECT *, row_number() OVER ({_PANE_ORDER}) AS pos, epoch_us(received_at) - epoch_us(lag(received_at) OVER ("
    f"{_PANE_ORDER})) AS gap FROM entries), grouped0 AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {SQ.SILENCE_S}000000 OR NOT "
    "regexp_matches(raw_content, '^(\\s|at |Caused by:|\\.\\.\\. \\d+ more)') THEN 1 ELSE 0 END) OVER (PARTITION BY session_name, "
    "pane_id ORDER BY pos) AS grp FROM gapped), grouped AS (SELECT *, max(grp) OVER (PARTITION BY session_name, pane_id) AS last_grp "
    "FROM grouped0)", RESTARTED_CTE)
_SILENCES = [("Stale", C.STALE_AFTER_S), ("Disconnected", C.DISCONNECT_AFTER_S)]
ORACLE["stream_liveness"] = with_entries(
    "SELECT session_name, pane_id, 'Active' AS status, received_at AS \"at\" FROM nexts WHERE prev IS NULL OR "
    f"epoch_us(received_at) - epoch_us(prev) > {C.STALE_AFTER_S}000000 " + " ".join(
        f"UNION ALL SELECT session_name, pane_id, '{name}', received_at + INTERVAL '{w} seconds' FROM nexts WHERE "
        f"epoch_us(nxt) - epoch_us(received_at) > {w}000000 OR (nxt IS NULL AND {_due(f'epoch_us(received_at) + {w}000000')})"
        for name, w in _SILENCES),
    f"{MARK}, nexts AS (SELECT *, lag(received_at) OVER (PARTITION BY session_name, pane_id ORDER BY received_at) AS prev, "
    "lead(received_at) OVER (PARTITION BY session_name, pane_id ORDER BY received_at) AS nxt FROM entries)", RESTARTED_CTE)
ORACLE["stream_cycle"] = ORACLE["restarted_cycle"]

ORACLE["severity_map"] = with_entries(
    "SELECT session_name, string_agg(severity || '=' || n, ',' ORDER BY severity) AS by_severity FROM (SELECT session_name, severity, "
    "count(*) AS n FROM entries GROUP BY ALL) GROUP BY session_name")
ORACLE["pipeline_counters"] = with_entries(
    "SELECT e.*, coalesce(deduplicated, 0) AS deduplicated, patterns, coalesce(i.n, 0) AS incidents, coalesce(a.n, 0) AS alerts, "
    "CASE WHEN seconds > 0 THEN captured / seconds END AS per_second FROM (SELECT session_name, count(*) AS captured, "
    "count_if(ts_source <> 'received' OR severity <> 'UNKNOWN' OR service IS NOT NULL) AS parsed, "
    "epoch(max(received_at)) - epoch(min(received_at)) AS seconds FROM entries GROUP BY session_name) e "
    "JOIN (SELECT session_name, CAST(sum(members - 1) AS BIGINT) AS deduplicated FROM lines GROUP BY session_name) USING (session_name) "
    "JOIN (SELECT session_name, count(DISTINCT signature) AS patterns FROM sig GROUP BY session_name) USING (session_name) "
    "LEFT JOIN (SELECT session_name, count(*) AS n FROM inc GROUP BY session_name) i USING (session_name) "
    "LEFT JOIN (SELECT session_name, count(*) AS n FROM al GROUP BY session_name) a USING (session_name)",
    f"{LINE_CLUSTERS}, {FIRST}, {PW}, {PWF}, {TRIG}, {INCIDENTS}, {REC_TRIG}, {RATES}, {TRANS}, {RW}, {ALL_TRIG}, {ALERTS}")
