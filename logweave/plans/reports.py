"""Reports (O1-O5, R1-R8): per-session documents built from the tables.

Every report is computed for all sessions in one job; per-session totals
are aggregated first and joined to the (small) per-session rows.  Top-k
selections use ``row_number() <= k``, which Spark plans as a group limit
(each task keeps k rows per session before the shuffle).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import LEVELS
from ..functions.text import cut_bytes
from ..operators import aggregates as A
from ..operators import filters as Fl

# --- fixed values -----------------------------------------------------------
DEFAULT_PAGE_LIMIT = 100
MAX_PAGE_LIMIT = 1000
DIGEST_LINES = 50
DEFAULT_TOKEN_BUDGET = 4000
BYTES_PER_TOKEN = 4
TRUNCATION_NOTE = "\n\n[Output truncated due to token limit]"
# ----------------------------------------------------------------------------

ORDER = ["timestamp", "pane_id", "sequence"]


def page_limit(limit: int | None) -> int:
    """O3 argument rule: default 100, at most 1000, bad values give the default."""
    if limit is None or limit <= 0:
        return DEFAULT_PAGE_LIMIT
    return min(limit, MAX_PAGE_LIMIT)


def entries_page(entries: DataFrame, offset: int = 0, limit: int | None = None,
                 since: dt.datetime | None = None, until: dt.datetime | None = None,
                 severity: str | None = None, service: str | None = None) -> DataFrame:
    """R2 = F8 + O3 + A7: one page per session in event order, with the
    filtered total of that session on every row."""
    lim = page_limit(limit)
    f = Fl.entries_query(entries, since, until, severity, service)
    totals = f.groupBy("session_name").agg(F.count(F.lit(1)).alias("total"))
    w = Window.partitionBy("session_name").orderBy(*ORDER)
    page = (f.withColumn("row_no", F.row_number().over(w).cast("long"))
            .where((F.col("row_no") > offset) & (F.col("row_no") <= offset + lim)))
    return page.join(totals, "session_name")


def head_with_remainder(rows: DataFrame, n: int, order: list) -> DataFrame:
    """O2: the first ``n`` rows per session plus how many were left out."""
    totals = rows.groupBy("session_name").agg(F.count(F.lit(1)).alias("_total"))
    w = Window.partitionBy("session_name").orderBy(*order)
    head = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return (head.join(totals, "session_name")
            .withColumn("omitted", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total"))


def _listed(rows):
    """``name:count`` pairs, joined by commas, of structs with n = -count."""
    return F.array_join(F.transform(rows, lambda x: F.concat(x["name"], F.lit(":"), (-x["n"]).cast("string"))), ",")


def window_summary(entries: DataFrame, start: dt.datetime, patterns: DataFrame,
                   incidents: DataFrame, alerts: DataFrame, top_k: int = 10) -> DataFrame:
    """One row per session over ``timestamp >= start``: counts per level,
    error+fatal, all services by count, the ``top_k`` patterns, active incidents
    and alerts."""
    e = entries.where(F.col("timestamp") >= F.lit(start))
    counts = A.severity_columns(e).withColumn(
        "total", sum((F.col(f"n_{lv.lower()}") for lv in LEVELS), F.lit(0)))
    services = (e.where(F.col("service").isNotNull()).groupBy("session_name", "service")
                .agg(F.count(F.lit(1)).alias("n")))
    # a session's services are few; the pattern list is cut to its top_k first
    svc = services.groupBy("session_name").agg(
        F.count(F.lit(1)).alias("services"),
        _listed(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("service").alias("name")))))
        .alias("services_by_count"))
    pw = patterns.where(F.col("last_seen") >= F.lit(start))
    best = Window.partitionBy("session_name").orderBy(F.desc("occurrence_count"), "first_seen", "signature")
    head = (pw.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= top_k).groupBy("session_name")
            .agg(_listed(F.array_sort(F.collect_list(F.struct(
                F.col("_r"), (-F.col("occurrence_count")).alias("n"), F.col("signature").alias("name")))))
                 .alias("top_patterns")))
    top = pw.groupBy("session_name").agg(F.count(F.lit(1)).alias("patterns")).join(head, "session_name")
    inc = (incidents.where(F.col("status") == "Active").groupBy("session_name")
           .agg(F.count(F.lit(1)).alias("active_incidents")))
    al = (alerts.where(F.col("status") == "Active").groupBy("session_name")
          .agg(F.count(F.lit(1)).alias("active_alerts")))
    out = counts
    for t in (svc, top, inc, al):
        out = out.join(t, "session_name", "left")
    return out.fillna(0, subset=["services", "patterns", "active_incidents", "active_alerts"])


def incident_digest(entries: DataFrame, min_level: str, since: dt.datetime,
                    lines: int = DIGEST_LINES) -> DataFrame:
    """Per session, over ``timestamp >= since`` and level >= ``min_level``
    (UNKNOWN excluded): error/fatal counts, sorted services and the newest
    ``lines`` lines with the number left out."""
    f = Fl.min_severity_known(entries.where(F.col("timestamp") >= F.lit(since)), min_level)
    stats = f.groupBy("session_name").agg(
        F.count_if(F.col("severity") == "ERROR").alias("error_count"),
        F.count_if(F.col("severity") == "FATAL").alias("fatal_count"),
        F.array_join(F.array_sort(F.collect_set("service")), ",").alias("services"))
    head = head_with_remainder(f, lines, [F.desc("timestamp"), "pane_id", "sequence"])
    return head.join(stats, "session_name").select(
        "session_name", "rank", "id", "timestamp", "severity", "raw_content", "omitted",
        "error_count", "fatal_count", "services")


def token_budget(turns: DataFrame, budget: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """R5 as row selection: per conversation the newest turns whose running
    token estimate (bytes / 4, rounded up) fits the budget, plus the first turn that does
    not fit cut to the remaining budget with the truncation note."""
    tokens = F.ceil(F.octet_length("text") / BYTES_PER_TOKEN)
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = (turns.withColumn("tokens", tokens.cast("long"))
         .withColumn("cum_tokens", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    t = t.withColumn("prev_tokens", F.col("cum_tokens") - F.col("tokens"))
    fits = F.col("cum_tokens") <= budget
    cut = (~fits) & (F.col("prev_tokens") < budget)
    text = F.when(fits, F.col("text")).otherwise(
        F.concat(cut_bytes(F.col("text"), (F.lit(budget) - F.col("prev_tokens")) * BYTES_PER_TOKEN),
                 F.lit(TRUNCATION_NOTE)))
    return (t.where(fits | cut)
            .select("conv_id", "turn", "role", "tokens", "cum_tokens",
                    (~fits).alias("truncated"), text.alias("context_text")))


def context_items(incidents: DataFrame, patterns: DataFrame, entries: DataFrame) -> DataFrame:
    """What competes for a context: active incidents before patterns before entries, one summary
    line each (session_name, kind, priority, sev_rank, at, item_id, text)."""
    from ..functions.severity import RANK
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("severity")], F.lit(RANK["UNKNOWN"]))

    def items(df, priority, kind, at, item, text):
        return df.select("session_name", F.lit(kind).alias("kind"), F.lit(priority).alias("priority"), rank.alias("sev_rank"),
                         F.col(at).alias("at"), F.col(item).alias("item_id"), text.alias("text"))

    level = F.concat(F.lit("["), F.col("severity"), F.lit("] "))
    return (items(Fl.active_only(incidents), 1, "incident", "started_at", "id", F.concat(level, F.col("title")))
            .unionByName(items(patterns, 2, "pattern", "last_seen", "signature", F.concat(
                level, F.col("occurrence_count").cast("string"), F.lit(" occurrences, sample "), F.col("sample_entry"))))
            .unionByName(items(entries, 3, "entry", "timestamp", "id", F.concat(
                level, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.coalesce("service", F.lit("-"))))))


def context_selection(items: DataFrame, budget: int = DEFAULT_TOKEN_BUDGET) -> DataFrame:
    """The items of each session that fit ``budget`` tokens (bytes / 4, rounded up, at
    least one an item), by priority, severity (highest first), recency and id, up to the first
    that does not fit.

    An item costs at least a token, so no more than ``budget`` items can fit: a
    group limit keeps that many a session and task, and the running sum is over
    ``budget`` rows however large the session."""
    order = ["priority", F.desc("sev_rank"), F.desc("at"), "item_id", "text"]
    best = Window.partitionBy("session_name").orderBy(*order)
    top = (items.withColumn("position", F.row_number().over(best).cast("long")).where(F.col("position") <= budget)
           .withColumn("tokens", F.greatest(F.ceil(F.octet_length("text") / BYTES_PER_TOKEN), F.lit(1)).cast("long")))
    upto = Window.partitionBy("session_name").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return (top.withColumn("cum_tokens", F.sum("tokens").over(upto)).where(F.col("cum_tokens") <= budget)
            .select("session_name", "position", "kind", "item_id", "at", "tokens", "cum_tokens", "text"))


def status_overview(liveness: DataFrame, stats: DataFrame) -> DataFrame:
    """Per session the worst pane status with the A4 counts."""
    order = F.when(F.col("status") == "Active", 0).when(F.col("status") == "Stale", 1).otherwise(2)
    s = liveness.groupBy("session_name").agg(
        F.max(order).alias("_o"), F.count(F.lit(1)).alias("panes"), F.max("last_seen").alias("last_seen"))
    status = F.element_at(F.array(F.lit("Active"), F.lit("Stale"), F.lit("Disconnected")), F.col("_o") + 1)
    return s.select("session_name", status.alias("status"), "panes", "last_seen").join(stats, "session_name")


def quick_summary(rates: DataFrame) -> DataFrame:
    """The latest error rate per session and rate key."""
    return rates.groupBy("session_name", "rate_key").agg(
        F.max_by("rate", F.struct(*[F.col(c) for c in ORDER])).alias("current_rate"))


def severity_rows(entries: DataFrame) -> DataFrame:
    """Severity counts per session, most frequent first (ties by rank)."""
    d = A.severity_distribution(entries)
    w = Window.partitionBy("session_name").orderBy(F.desc("entry_count"), "sev_rank")
    return d.withColumn("position", F.row_number().over(w).cast("long"))


def iso(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def json_documents(df: DataFrame, name: str, order: list, fields: list[Column], limit: int, offset: int = 0,
                   echo: dict | None = None) -> DataFrame:
    """One JSON document a session: its name, the total of its rows, the page
    (``offset``, ``limit``, at most ``MAX_PAGE_LIMIT``), the filters that were asked for, and the page's rows as
    objects of ``fields`` under ``name``.  A group limit keeps the page before rows are gathered."""
    lim = page_limit(limit)
    best = Window.partitionBy("session_name").orderBy(*order)
    page = (df.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= offset + lim).where(F.col("_n") > offset)
            .select("session_name", F.struct("_n", F.struct(*fields).alias("_o")).alias("_x")))
    rows = page.groupBy("session_name").agg(F.transform(F.sort_array(F.collect_list("_x")), lambda x: x["_o"]).alias(name))
    total = df.groupBy("session_name").agg(F.count(F.lit(1)).alias("total"))
    asked = F.struct(*[F.lit(v).alias(k) for k, v in echo.items()]).alias("filters") if echo else None
    doc = F.struct("session_name", "total", F.lit(offset).alias("offset"), F.lit(lim).alias("limit"),
                   *([asked] if echo else []), name)
    return total.join(rows, "session_name").select("session_name", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def entry_documents(entries: DataFrame, limit: int, offset: int = 0, since: dt.datetime | None = None,
                    severity: str | None = None, service: str | None = None) -> DataFrame:
    """R2: the entries document with its filters."""
    fields = [F.col("id"), iso("timestamp").alias("timestamp"), F.col("severity"), F.col("service"), F.col("raw_content")]
    return json_documents(Fl.entries_query(entries, since, None, severity, service), "entries", ORDER, fields, limit, offset,
                          {"since": None if since is None else f"{since:%Y-%m-%dT%H:%M:%SZ}", "severity": severity, "service": service})


def pattern_documents(patterns: DataFrame, limit: int) -> DataFrame:
    fields = [F.col("signature"), F.upper("severity").alias("severity"), F.col("occurrence_count"), iso("first_seen").alias("first_seen"),
              iso("last_seen").alias("last_seen"), F.col("sample_entry")]
    return json_documents(patterns, "patterns", [F.desc("occurrence_count"), "first_seen", "signature"], fields, limit)


def incident_documents(incidents: DataFrame, limit: int) -> DataFrame:
    fields = [F.col("id"), F.col("title"), F.upper("severity").alias("severity"), F.col("status"), iso("started_at").alias("started_at"),
              iso("resolved_at").alias("resolved_at"), F.col("affected_services"), F.size("pattern_ids").alias("pattern_count")]
    return json_documents(incidents, "incidents", [F.desc("started_at"), "id"], fields, limit)


def alert_documents(alerts: DataFrame, limit: int) -> DataFrame:
    fields = [F.col("id"), F.col("alert_type").alias("type"), iso("triggered_at").alias("triggered_at"), F.col("status"),
              F.col("message"), F.col("threshold"), F.col("current_value")]
    return json_documents(alerts, "alerts", [F.desc("triggered_at"), "id"], fields, limit)


def errors_only(entries: DataFrame) -> DataFrame:
    """Restrict a summary to ERROR and FATAL lines (then apply R1)."""
    return Fl.severe_only(entries)
