"""log_lines -> log_entries as one projection of built-in expressions.

Cascade per line: a JSON object, else logfmt (any ``=``), then the text
rules (leading timestamp, severity word, service tag, key=value pairs).
``cascade="fixed"`` (default) lets structured values win over text rules
and merges the field maps; ``cascade="reference"`` lets the text rules
overwrite and replaces the map with the key=value pairs.
``ts_mode="fixed"`` reads zone-less text times as UTC and takes the syslog
year from ``received_at``; ``ts_mode="reference"`` only accepts zoned ISO
text times.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .severity import normalize_level, sev_rank

# --- fixed values: recognised line shapes ----------------------------------
TS_ISO = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s*"
TS_STANDARD = r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:,\d{3})?)\s*"
TS_SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s*"
SEVERITY_WORD = r"(?i)\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL)\b"
SERVICE_TAG = r"(?:\[([a-zA-Z0-9_-]+)\]|service[=:]([a-zA-Z0-9_-]+))"
SERVICE_TAG_SKIP_LEVELS = (r"(?:\[(?!(?i:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\])"
                           r"(?![0-9-]+\])([a-zA-Z0-9_-]+)\]|service[=:]([a-zA-Z0-9_-]+))")
KEY_VALUE = r"(\w+)=([^\s,]+)"
LOGFMT_PAIR = r'([^\s=]*)=\s*("(?:\\.|[^"\\])*"?|\S*)'
JSON_TS_KEYS = ["timestamp", "time", "ts"]
JSON_LEVEL_KEYS = ["level", "severity", "log_level"]
JSON_SERVICE_KEYS = ["service", "component", "logger"]
JSON_MESSAGE_KEYS = ["message", "msg", "log"]
JSON_CONSUMED_KEYS = ["timestamp", "time", "level", "severity", "service", "component",
                      "message", "msg"]
LOGFMT_LEVEL_KEYS = ["level", "lvl"]
LOGFMT_TS_KEYS = ["ts", "timestamp"]
LOGFMT_SERVICE_KEYS = ["service", "svc"]
# ----------------------------------------------------------------------------
# A pair can only start at the beginning, after whitespace or where the
# previous pair ended (a key never holds '=' or whitespace), so anchoring
# the Java pattern there gives the same pairs without retrying every
# position of long tokens (Java regexes backtrack; RE2 needs no anchor).
LOGFMT_PAIR_JAVA = r"(?:(?<=\s)|\G)" + LOGFMT_PAIR

ENTRY_COLUMNS = ["id", "session_name", "pane_id", "sequence", "timestamp", "ts_source",
                 "severity", "sev_rank", "service", "raw_content", "parsed_fields",
                 "received_at"]


def _empty_map() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def _first_present(m: Column, keys: list[str], values: Column | None = None) -> Column:
    """Value of the first key present in ``m`` (present-but-null stays null),
    taken from ``values`` if given; one look-up, the key being chosen before."""
    key = None
    for k in keys:
        cond = F.map_contains_key(m, k)
        key = F.when(cond, F.lit(k)) if key is None else key.when(cond, F.lit(k))
    return (m if values is None else values)[key]


def _json_strings(raw: Column, m: Column) -> Column:
    """The entries of the JSON map that are strings.  Types are looked up only
    in lines where one of the keys read below may hold something else."""
    keys = [*JSON_TS_KEYS, *JSON_LEVEL_KEYS, *JSON_SERVICE_KEYS, *JSON_MESSAGE_KEYS]
    other = raw.rlike(r'"(?:' + "|".join(keys) + r')"\s*:\s*[^"\s]')
    typed = F.map_filter(F.from_json(raw, "map<string,variant>"),
                         lambda k, v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    # bound once a line, not parsed again for every entry of the map
    strings = F.transform(F.array(typed), lambda t: F.map_filter(m, lambda k, v: F.map_contains_key(t, k)))[0]
    return F.when(other, strings).otherwise(m)


def entry_id(session: Column, pane_id: Column, sequence: Column, received_at: Column, raw: Column) -> Column:
    """Deterministic entry id from all that a line came with: panes of two sessions may
    share an id and a restarted capture counts from 1 again.  Lines equal in all
    five are copies of one entry and share its id; no operator joins on it."""
    return F.md5(F.concat_ws("|", session, pane_id, sequence.cast("string"), F.unix_micros(received_at).cast("string"), raw))


def _kv_map(raw: Column, pattern: str) -> Column:
    keys = F.regexp_extract_all(raw, F.lit(pattern), 1)
    vals = F.regexp_extract_all(raw, F.lit(pattern), 2)
    return F.map_from_arrays(keys, vals)


def _logfmt_map(pairs: Column) -> Column:
    """The field map of the pairs (whole matches of ``LOGFMT_PAIR_JAVA``): a key ends at the first ``=``, its value
    begins after the whitespace behind that."""
    vals = F.transform(pairs, lambda p: F.ltrim(p.substr(F.instr(p, "=") + 1, F.length(p)), F.lit(" \t\n\x0b\f\r")))
    vals = F.transform(vals, lambda v: F.when(
        v.startswith('"'),
        F.regexp_replace(
            F.when((F.length(v) >= 2) & v.endswith('"'), v.substr(F.lit(2), F.length(v) - 2))
            .otherwise(v.substr(F.lit(2), F.length(v))),
            r"(?s)\\(.)", "$1"))
        .otherwise(v))
    return F.map_from_arrays(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)), vals)


def _text_matches(df: DataFrame, raw: Column, no_ts: Column, no_level: Column, no_service: Column, service_tag: str) -> DataFrame:
    """Adds what the text rules find ('': nothing), each pattern as a column of its own, so that it runs once a line
    however often its match is used, and only in lines (``no_*``) whose field is not known yet."""
    found = {"_iso": (no_ts, TS_ISO, 1), "_std": (no_ts, TS_STANDARD, 1), "_sys": (no_ts, TS_SYSLOG, 1),
             "_word": (no_level, SEVERITY_WORD, 1), "_tag": (no_service, service_tag, 0)}
    return df.withColumns({name: F.when(cond, F.regexp_extract(raw, pattern, group))
                           for name, (cond, pattern, group) in found.items()})


def _parse_text_ts(received_at: Column, ts_mode: str):
    iso, std, sys_ = F.col("_iso"), F.col("_std"), F.col("_sys")
    if ts_mode == "reference":
        zoned = iso.rlike(r"(Z|[+-]\d{2}:\d{2})$")
        ts = F.when((iso != "") & zoned, iso.try_cast("timestamp"))
        src = F.when(ts.isNotNull(), F.lit("text_iso"))
        return ts, src
    iso_ts = F.when(iso != "", iso.try_cast("timestamp"))
    std_ts = F.when(std != "", F.regexp_replace(std, ",", ".").try_cast("timestamp"))
    sys_ts = F.when(sys_ != "", F.try_to_timestamp(
        F.concat(F.year(received_at).cast("string"), F.lit(" "), F.regexp_replace(sys_, r"\s+", " ")),
        F.lit("yyyy MMM d HH:mm:ss")))
    ts = F.coalesce(iso_ts, std_ts, sys_ts)
    src = (F.when(iso_ts.isNotNull(), F.lit("text_iso"))
           .when(std_ts.isNotNull(), F.lit("text_standard"))
           .when(sys_ts.isNotNull(), F.lit("text_syslog")))
    return ts, src


def parse_entries(lines: DataFrame, cascade: str = "fixed", ts_mode: str = "fixed",
                  skip_level_tags: bool = False) -> DataFrame:
    """Parse ``log_lines`` into ``log_entries`` (see module doc)."""
    raw = F.col("raw")
    received = F.col("received_at")
    # only a line opening with '{' can be a JSON object: skip the JSON
    # parser for all others
    jm = F.when(raw.rlike(r"^[ \t\r\n]*\{"), F.from_json(raw, "map<string,string>"))
    df = lines.withColumn("_jm", jm)
    df = df.withColumn("_fmt", F.when(F.col("_jm").isNotNull(), F.lit("json"))
                       .when(raw.contains("="), F.lit("logfmt")).otherwise(F.lit("text")))
    df = df.withColumn("_pairs", F.when(F.col("_fmt") == "logfmt", F.regexp_extract_all(raw, F.lit(LOGFMT_PAIR_JAVA), 0)))
    df = df.withColumn("_lm", _logfmt_map(F.col("_pairs")))

    df = df.withColumn("_js", F.when(F.col("_jm").isNotNull(), _json_strings(raw, F.col("_jm"))))

    j, js, lf, fmt = F.col("_jm"), F.col("_js"), F.col("_lm"), F.col("_fmt")
    # a line has one of the maps, and no value of ``lf`` is NULL
    s_ts_txt, s_level, s_service = (F.coalesce(_first_present(j, a, js), *[lf[k] for k in b]) for a, b in (
        (JSON_TS_KEYS, LOGFMT_TS_KEYS), (JSON_LEVEL_KEYS, LOGFMT_LEVEL_KEYS), (JSON_SERVICE_KEYS, LOGFMT_SERVICE_KEYS)))
    j_message = _first_present(j, JSON_MESSAGE_KEYS, js)
    if ts_mode == "reference":
        df = df.withColumn("_s_ts_txt", s_ts_txt)
        s_ts_txt = F.col("_s_ts_txt")
        s_ts = F.when(s_ts_txt.rlike(r"(Z|[+-]\d{2}:\d{2})$"), s_ts_txt.try_cast("timestamp"))
    else:
        s_ts = s_ts_txt.try_cast("timestamp")
    df = df.withColumns({"_s_ts": s_ts, "_s_level": s_level, "_s_service": s_service})
    s_ts, s_level, s_service = F.col("_s_ts"), F.col("_s_level"), F.col("_s_service")

    svc_pat = SERVICE_TAG_SKIP_LEVELS if skip_level_tags else SERVICE_TAG
    first = [F.lit(True)] * 3 if cascade == "reference" else [s_ts.isNull(), s_level.isNull(), s_service.isNull()]
    df = _text_matches(df, raw, *first, svc_pat)
    t_ts, t_src = _parse_text_ts(received, ts_mode)
    word, tag = F.col("_word"), F.col("_tag")
    t_level = F.when(word != "", word)
    # "[name]", or "service" and a sign before the name
    t_service = F.when(tag.startswith("["), tag.substr(F.lit(2), F.length(tag) - 2)).when(tag != "", tag.substr(F.lit(9), F.length(tag)))
    kv = _kv_map(raw, KEY_VALUE)

    # structured field map: JSON keys (null -> 'null') minus consumed ones, plus message
    consumed = F.array(*[F.lit(k) for k in JSON_CONSUMED_KEYS])
    json_fields = F.map_filter(F.transform_values(j, lambda k, v: F.coalesce(v, F.lit("null"))),
                               lambda k, v: ~F.array_contains(consumed, k))
    json_fields = F.when(j_message.isNotNull(),
                         F.map_concat(json_fields, F.create_map(F.lit("message"), j_message))
                         ).otherwise(json_fields)
    s_map = F.when(fmt == "json", json_fields).when(fmt == "logfmt", lf)

    if cascade == "reference":
        timestamp = F.coalesce(t_ts, s_ts, received)
        ts_source = (F.when(t_ts.isNotNull(), t_src)
                     .when(s_ts.isNotNull(), fmt).otherwise(F.lit("received")))
        level = F.coalesce(t_level, s_level)
        service = F.coalesce(t_service, s_service)
        fields = kv
    else:
        timestamp = F.coalesce(s_ts, t_ts, received)
        ts_source = (F.when(s_ts.isNotNull(), fmt)
                     .when(t_ts.isNotNull(), t_src).otherwise(F.lit("received")))
        level = F.coalesce(s_level, t_level)
        service = F.coalesce(s_service, t_service)
        sm = F.coalesce(s_map, _empty_map())
        fields = F.map_concat(F.map_filter(kv, lambda k, v: ~F.map_contains_key(sm, k)), sm)

    severity = F.coalesce(normalize_level(level), F.lit("UNKNOWN"))

    out = df.select(
        entry_id(F.col("session_name"), F.col("pane_id"), F.col("sequence"), received, raw).alias("id"),
        "session_name", "pane_id", "sequence",
        timestamp.alias("timestamp"), ts_source.alias("ts_source"),
        severity.alias("severity"), service.alias("service"),
        raw.alias("raw_content"), fields.alias("parsed_fields"), received.alias("received_at"))
    out = out.withColumn("sev_rank", sev_rank(F.col("severity"))).select(*ENTRY_COLUMNS)
    return observe_counters(out)


_OBSERVATIONS = itertools.count(1)


def observe_counters(entries: DataFrame) -> DataFrame:
    """Parsed-line counter collected on the fly by ``observe``.

    The observation node also ends the parse for the optimizer: filters on
    parsed columns are not substituted into the parse expressions below it
    (that substitution copies the expressions into every predicate), while
    unused columns are still pruned through it.  The counter reads no
    column, so it forces no parsing work of its own.
    """
    return entries.observe(f"log_entries_{next(_OBSERVATIONS)}", F.count(F.lit(1)).alias("parsed"))


def fields_text(fields: Column) -> Column:
    """Map -> deterministic text ``k=v`` sorted by key, ``\\u0001``-joined (for comparisons)."""
    entries = F.transform(F.map_entries(fields),
                          lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(entries), "\u0001")


# ---- P11: user patterns with named groups -----------------------------------

CUSTOM_FIELDS = ["timestamp", "level", "severity", "service", "message"]


def custom_pattern_fields(raw: Column, patterns: list[str]) -> Column:
    """The first of ``patterns`` that matches ``raw`` fills a struct of
    ``pattern_index`` and the named groups timestamp/level/severity/service/
    message (missing groups are NULL).  ``(?P<name>`` is accepted and
    rewritten to Java's ``(?<name>``; group names are resolved to indexes
    on the driver, extraction is ``regexp_extract`` per group."""
    import re as _re
    branches = []
    for i, p in enumerate(patterns):
        groups = _re.compile(p).groupindex
        jp = p.replace("(?P<", "(?<")
        vals = [F.regexp_extract(raw, jp, groups[f]) if f in groups else F.lit(None).cast("string")
                for f in CUSTOM_FIELDS]
        branches.append((raw.rlike(jp), F.struct(F.lit(i).alias("pattern_index"),
                                                 *[v.alias(f) for v, f in zip(vals, CUSTOM_FIELDS)])))
    expr = None
    for cond, val in branches:
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr
