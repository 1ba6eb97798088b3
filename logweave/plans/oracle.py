"""DuckDB SQL twins of the Spark queries (the correctness oracle).

Each query in ``plans.catalog`` has a SQL string here that DuckDB runs on the
same parquet tables (registered as views).  The shared CTEs below render
``log_lines`` from ``events`` and parse them with the same rules as
``functions.parse``; they are plain SQL text, composed by small helpers.
"""

from __future__ import annotations

from ..functions import parse as P
from ..functions import severity as S
from ..functions import text as T


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def level_case(x: str) -> str:
    parts = " ".join(f"WHEN upper({x}) IN ({', '.join(q(w) for w in words)}) THEN {q(level)}"
                     for level, words in S.LEVEL_ALIASES.items())
    return f"(CASE WHEN {x} IS NULL THEN NULL {parts} ELSE 'UNKNOWN' END)"


def rank_case(x: str) -> str:
    parts = " ".join(f"WHEN {q(level)} THEN {r}" for level, r in S.RANK.items())
    return f"(CASE {x} {parts} ELSE 6 END)"


def keyword_case(x: str) -> str:
    parts = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({x}), {q(w)})" for w in words) + f" THEN {q(level)}"
        for level, words in S.KEYWORD_CLASSES)
    return f"(CASE {parts} ELSE 'UNKNOWN' END)"


def normalize_sql(x: str, full: bool) -> str:
    for pattern, repl in (T.FULL_RULES if full else T.SIGNATURE_RULES):
        x = f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"
    return x


def signature_sql(x: str) -> str:
    return f"md5({normalize_sql(x, False)})"


LOG_LINES_CTE = r"""
ev AS (
  SELECT event_id, user_id, ts AS received_at,
         'svc-' || CAST(user_id % 7 AS VARCHAR) AS svc,
         CASE WHEN event_type = 'error' THEN (CASE WHEN value < 50 THEN 'ERROR' ELSE 'FATAL' END)
              WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'purchase' THEN 'INFO'
              WHEN event_type = 'click' THEN 'DEBUG' WHEN event_type = 'view' THEN 'TRACE'
              ELSE 'INFO' END AS lvl,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso,
         strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS std,
         strftime(ts, '%b %d %H:%M:%S') AS sys,
         CAST(event_id % 100 AS VARCHAR) AS k
  FROM events),
ev2 AS (
  SELECT *, CASE event_id % 6
      WHEN 0 THEN 'Connection refused to db at localhost:' || CAST(5000 + event_id % 50 AS VARCHAR)
      WHEN 1 THEN 'NullPointerException at Handler.java:' || CAST(10 + event_id % 90 AS VARCHAR)
      WHEN 2 THEN 'Starting ' || svc
      WHEN 3 THEN 'Stopping ' || svc || ' (SIGTERM)'
      WHEN 4 THEN 'request took ms=' || CAST(event_id % 900 AS VARCHAR)
      ELSE 'segfault at 0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 12) END AS msg
  FROM ev),
log_lines AS (
  SELECT 'sess-' || CAST(user_id % 3 AS VARCHAR) AS session_name,
         'pane-' || CAST(user_id % 12 AS VARCHAR) AS pane_id,
         row_number() OVER (PARTITION BY user_id % 12 ORDER BY received_at, event_id) AS sequence,
         received_at,
         CASE (event_id // 6) % 6
           WHEN 0 THEN iso || ' [' || svc || '] ' || lvl || ': ' || msg
           WHEN 1 THEN '{"timestamp":"' || iso || '","level":"' || lower(lvl) || '","service":"' || svc
                       || '","message":"' || msg || '","k":' || k || '}'
           WHEN 2 THEN 'ts=' || iso || ' level=' || lower(lvl) || ' service=' || svc || ' msg="' || msg
                       || '" k=' || k
           WHEN 3 THEN std || ' ' || lvl || ' service=' || svc || ' ' || msg
           WHEN 4 THEN sys || ' ' || svc || ' ' || msg
           ELSE msg END AS raw
  FROM ev2)"""


RESTARTED_CTE = r"""
ev AS (
  SELECT event_id, ts AS received_at, 'svc-' || CAST(user_id % 7 AS VARCHAR) AS svc,
         CASE WHEN user_id % 5 = 4 AND ts < TIMESTAMP '2024-01-10' THEN 'sess-old'
              ELSE 'sess-' || CAST(user_id % 4 AS VARCHAR) END AS session_name,
         'pane-' || CAST(user_id % 6 AS VARCHAR) AS pane_id,
         CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARN' ELSE 'INFO' END AS lvl,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS std
  FROM events),
ev2 AS (
  SELECT *, CASE event_id % 7
      WHEN 0 THEN 'Connection refused to db at localhost:' || CAST(5000 + event_id % 50 AS VARCHAR)
      WHEN 1 THEN 'NullPointerException at Handler.java:' || CAST(10 + event_id % 90 AS VARCHAR)
      WHEN 2 THEN 'Starting ' || svc WHEN 3 THEN svc || ' ready' WHEN 4 THEN 'Stopping ' || svc
      ELSE 'request took ms=' || CAST(event_id % 900 AS VARCHAR) END AS msg
  FROM ev),
log_lines AS (
  SELECT session_name, pane_id,
         row_number() OVER (PARTITION BY session_name, pane_id, date_trunc('day', received_at)
                            ORDER BY received_at, event_id) AS sequence, received_at,
         CASE WHEN event_id % 7 = 5 THEN '    at com.example.Handler.run(Handler.java:' || CAST(event_id % 9 AS VARCHAR) || ')'
           WHEN (event_id // 7) % 4 = 0 THEN iso || ' [' || svc || '] ' || lvl || ': ' || msg
           WHEN (event_id // 7) % 4 = 1 THEN '{"time":"' || iso || '","level":' || CAST(event_id % 60 AS VARCHAR)
                || ',"service":"' || svc || '","msg":"' || msg || '"}'
           WHEN (event_id // 7) % 4 = 2 THEN std || ' ' || lvl || ' service=' || svc || ' ' || msg
           ELSE msg END AS raw
  FROM ev2)"""


def _lookup(keys: str, vals: str, key: str) -> str:
    """Value of the last occurrence of ``key`` (last-wins map semantics)."""
    return (f"(CASE WHEN list_contains({keys}, {q(key)}) THEN "
            f"{vals}[len({keys}) + 1 - list_position(list_reverse({keys}), {q(key)})] END)")


def _first_present_lists(keys: str, vals: str, names: list[str]) -> str:
    parts = " ".join(f"WHEN list_contains({keys}, {q(n)}) THEN {_lookup(keys, vals, n)}" for n in names)
    return f"(CASE {parts} END)"


def _first_present_json(names: list[str]) -> str:
    parts = " ".join(f"WHEN json_exists(raw, {q('$.' + n)}) THEN CASE WHEN json_type(raw, {q('$.' + n)}) = 'VARCHAR' "
                     f"THEN json_extract_string(raw, {q('$.' + n)}) END" for n in names)
    return f"(CASE {parts} END)"


def _dedup_pairs(keys: str, vals: str) -> str:
    """list of (k, v) structs keeping the last occurrence of each key."""
    return (f"list_filter(list_zip({keys}, {vals}), "
            f"lambda e, i: NOT list_contains(({keys})[i+1:], e[1]))")


def entries_cte() -> str:
    iso = f"regexp_extract(raw, {q(P.TS_ISO)}, 1)"
    std = f"regexp_extract(raw, {q(P.TS_STANDARD)}, 1)"
    sys_ = f"regexp_extract(raw, {q(P.TS_SYSLOG)}, 1)"
    consumed = ", ".join(q(k) for k in P.JSON_CONSUMED_KEYS)
    lf_vals = ("list_transform(regexp_extract_all(raw, " + q(P.LOGFMT_PAIR) + ", 2), lambda v: "
               "CASE WHEN starts_with(v, '\"') THEN regexp_replace("
               "CASE WHEN length(v) >= 2 AND ends_with(v, '\"') THEN substr(v, 2, length(v) - 2) "
               "ELSE substr(v, 2) END, '(?s)\\\\(.)', '\\1', 'g') ELSE v END)")
    return f"""
p0 AS (
  SELECT *, CASE WHEN (CASE WHEN json_valid(raw) THEN json_type(raw) END) = 'OBJECT' THEN 'json'
                 WHEN contains(raw, '=') THEN 'logfmt' ELSE 'text' END AS fmt
  FROM log_lines),
p1 AS (
  SELECT *,
    CASE WHEN fmt = 'logfmt' THEN regexp_extract_all(raw, {q(P.LOGFMT_PAIR)}, 1) END AS lk,
    CASE WHEN fmt = 'logfmt' THEN {lf_vals} END AS lv,
    regexp_extract_all(raw, {q(P.KEY_VALUE)}, 1) AS kk,
    regexp_extract_all(raw, {q(P.KEY_VALUE)}, 2) AS kv,
    CASE WHEN {iso} <> '' THEN try_cast({iso} AS TIMESTAMP) END AS iso_ts,
    CASE WHEN {std} <> '' THEN try_cast(replace({std}, ',', '.') AS TIMESTAMP) END AS std_ts,
    CASE WHEN {sys_} <> '' THEN try_strptime(CAST(year(received_at) AS VARCHAR) || ' ' ||
         regexp_replace({sys_}, '\\s+', ' ', 'g'), '%Y %b %d %H:%M:%S') END AS sys_ts,
    regexp_extract(raw, {q(P.SEVERITY_WORD)}, 1) AS t_word,
    coalesce(nullif(regexp_extract(raw, {q(P.SERVICE_TAG)}, 1), ''),
             nullif(regexp_extract(raw, {q(P.SERVICE_TAG)}, 2), '')) AS t_service
  FROM p0),
p2 AS (
  SELECT *,
    CASE WHEN fmt = 'json' THEN {_first_present_json(P.JSON_TS_KEYS)}
         WHEN fmt = 'logfmt' THEN {_first_present_lists('lk', 'lv', P.LOGFMT_TS_KEYS)} END AS s_ts_txt,
    CASE WHEN fmt = 'json' THEN {_first_present_json(P.JSON_LEVEL_KEYS)}
         WHEN fmt = 'logfmt' THEN {_first_present_lists('lk', 'lv', P.LOGFMT_LEVEL_KEYS)} END AS s_level,
    CASE WHEN fmt = 'json' THEN {_first_present_json(P.JSON_SERVICE_KEYS)}
         WHEN fmt = 'logfmt' THEN {_first_present_lists('lk', 'lv', P.LOGFMT_SERVICE_KEYS)} END AS s_service,
    CASE WHEN fmt = 'json' THEN {_first_present_json(P.JSON_MESSAGE_KEYS)} END AS j_message,
    coalesce(iso_ts, std_ts, sys_ts) AS t_ts,
    CASE WHEN iso_ts IS NOT NULL THEN 'text_iso' WHEN std_ts IS NOT NULL THEN 'text_standard'
         WHEN sys_ts IS NOT NULL THEN 'text_syslog' END AS t_src,
    CASE WHEN t_word <> '' THEN {level_case('t_word')} END AS t_sev
  FROM p1),
p3 AS (
  SELECT *, try_cast(s_ts_txt AS TIMESTAMP) AS s_ts, {level_case('s_level')} AS s_sev,
    CASE WHEN fmt = 'json' THEN
           list_concat(list_transform(list_filter(json_keys(raw), lambda k: NOT list_contains([{consumed}], k)),
                         lambda k: {{'k': k, 'v': coalesce(json_extract_string(raw, '$."' || k || '"'), 'null')}}),
                       CASE WHEN j_message IS NOT NULL THEN [{{'k': 'message', 'v': j_message}}]
                            ELSE [] END)
         WHEN fmt = 'logfmt' THEN list_transform({_dedup_pairs('lk', 'lv')}, lambda e: {{'k': e[1], 'v': e[2]}})
    END AS s_pairs,
    list_transform({_dedup_pairs('kk', 'kv')}, lambda e: {{'k': e[1], 'v': e[2]}}) AS kv_pairs
  FROM p2),
entries AS (
  SELECT md5(concat_ws('|', session_name, pane_id, sequence, epoch_us(received_at), raw)) AS id, session_name, pane_id, sequence,
    coalesce(s_ts, t_ts, received_at) AS timestamp,
    CASE WHEN s_ts IS NOT NULL THEN fmt WHEN t_ts IS NOT NULL THEN t_src ELSE 'received' END AS ts_source,
    coalesce(s_sev, t_sev, 'UNKNOWN') AS severity,
    {rank_case("coalesce(s_sev, t_sev, 'UNKNOWN')")} AS sev_rank,
    coalesce(s_service, t_service) AS service,
    raw AS raw_content,
    list_concat(list_filter(kv_pairs, lambda e: NOT list_contains(
                  list_transform(coalesce(s_pairs, []), lambda x: x.k), e.k)),
                coalesce(s_pairs, [])) AS field_pairs,
    received_at
  FROM p3)"""


def fields_text_sql(pairs: str) -> str:
    return (f"array_to_string(list_sort(list_transform({pairs}, "
            f"lambda e: e.k || '=' || coalesce(e.v, ''))), chr(1))")


def with_entries(select_sql: str, extra_ctes: str = "", lines: str = LOG_LINES_CTE) -> str:
    """Full statement: fixture lines + parsed entries + optional CTEs + select."""
    ctes = lines + "," + entries_cte()
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return "WITH RECURSIVE " + ctes + "\n" + select_sql


def level_of_sql(rank: str) -> str:
    return "([" + ", ".join(q(x) for x in S.LEVELS) + f"])[{rank} + 1]"


def anchored_sql(name: str, src: str, keys: list[str], ts: str, order: list[str], width_s: int) -> str:
    """CTEs ``{name}_anch`` (recursive window starts) and ``{name}`` (rows of
    ``src`` with window_start and window_count)."""
    k = ", ".join(keys)
    on_a = " AND ".join(f"s.{c} = a.{c}" for c in keys)
    part = ", ".join(f"s.{c}" for c in keys)
    ordr = ", ".join(f"s.{c}" for c in [ts, *order])
    iv = f"INTERVAL '{int(width_s)} seconds'"
    return f"""{name}_anch({k}, anchor) AS (
  SELECT {k}, min({ts}) FROM {src} GROUP BY {k}
  UNION ALL
  SELECT {", ".join("a." + c for c in keys)}, min(s.{ts}) FROM {name}_anch a JOIN {src} s
    ON {on_a} AND s.{ts} > a.anchor + {iv} GROUP BY {", ".join("a." + c for c in keys)}),
{name} AS (
  SELECT s.*, a.anchor AS window_start,
         row_number() OVER (PARTITION BY {part}, a.anchor ORDER BY {ordr}) AS window_count
  FROM {src} s JOIN {name}_anch a ON {on_a} AND s.{ts} >= a.anchor AND s.{ts} <= a.anchor + {iv})"""
