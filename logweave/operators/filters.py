"""Row filters over ``log_entries``.

All are plain predicates.  On a stored table of entries Catalyst pushes them
into the scan.  On lines parsed in the same plan a filter on a parsed column
runs after the parse; a filter on the text alone, or the test of the text that a level or
service implies, belongs before it (``matching_lines``, ``lines_with``, ``lines_of``), so that
only its hits are parsed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import arrival_positions, join_keys

from ..functions.severity import LEVEL_ALIASES, RANK, classify_keywords


def severity_or_pattern(text: Column, min_level: str, pattern: str | None = None) -> Column:
    """keyword severity >= ``min_level`` (and ``pattern`` if given), or the
    pattern alone rescues lower lines.  With a pattern this is the pattern."""
    if pattern is not None:
        return text.rlike(pattern)
    return classify_rank(text) >= RANK[min_level]


def classify_rank(text: Column) -> Column:
    from ..functions.severity import sev_rank
    return sev_rank(classify_keywords(text))


def matching_lines(lines: DataFrame, min_level: str = "ERROR", pattern: str | None = None) -> DataFrame:
    """F1 on lines not parsed yet."""
    return lines.where(severity_or_pattern(F.col("raw"), min_level, pattern))


def lines_with(lines: DataFrame, needle: str) -> DataFrame:
    """The substring test of F9 on lines not parsed yet."""
    return lines.where(F.col("raw").contains(needle))


def implied_by(raw: Column, severity: str | None = None, service: str | None = None) -> Column:
    """A test of the raw text that every line with this parsed level and service passes, for
    use before the parse (F6, F8): one of the level's words stands in it, and the service does.
    A line with escapes or letters beyond ASCII, whose parsed values may be spelt differently,
    passes too; UNKNOWN implies nothing."""
    escaped = raw.rlike(r"[\\\x{80}-\x{10FFFF}]")
    cond = F.lit(True)
    if severity is not None and severity.upper() in LEVEL_ALIASES:
        cond = cond & (raw.rlike("(?i)" + "|".join(LEVEL_ALIASES[severity.upper()])) | escaped)
    if service is not None:
        cond = cond & (raw.contains(service) | escaped)
    return cond


def lines_of(lines: DataFrame, severity: str | None = None, service: str | None = None) -> DataFrame:
    """Lines not parsed yet that can have the level and service; the exact filter follows the parse."""
    return lines.where(implied_by(F.col("raw"), severity, service))


def line_filter(entries: DataFrame, min_level: str = "ERROR", pattern: str | None = None,
                limit: int | None = None) -> DataFrame:
    """F1 over all panes in arrival order; ``limit`` stops early (snapshot form)."""
    out = (entries.where(severity_or_pattern(F.col("raw_content"), min_level, pattern))
           .withColumn("detected_severity", classify_keywords(F.col("raw_content"))))
    if limit is not None:
        out = out.orderBy("pane_id", "sequence").limit(limit)
    return out


def context_lines(entries: DataFrame, match: Column, n: int) -> DataFrame:
    """every line within ``n`` lines (same pane, by arrival) of a matching line.

    Each match emits the ``2n+1`` positions around it; an equi-join then picks
    the lines.  No per-pane window, so a busy pane is spread over all tasks.
    """
    key = ["session_name", "pane_id", "_pos"]
    placed = arrival_positions(entries.withColumn("is_match", match), "raw_content")
    near = (placed.where("is_match")
            .select("session_name", "pane_id", F.explode(F.sequence(F.col("_pos") - n, F.col("_pos") + n)).alias("_pos"))
            .groupBy(*key).agg(F.count(F.lit(1)).alias("matches_near")))
    return join_keys(placed, near, key).drop("_pos")


def search_text(entries: DataFrame, needle: str, severity: str | None = None,
                per_session: int = 50) -> DataFrame:
    """case-sensitive substring (+ exact severity), first ``per_session`` hits
    in arrival order, rendered ``[ts] line``.

    ``row_number() <= k`` is planned as a group limit: each task keeps its own
    top k per session before the shuffle, so a large session ships k rows per
    task, not all its hits.
    """
    cond = F.col("raw_content").contains(needle)
    if severity is not None:
        cond = cond & (F.upper(F.col("severity")) == severity.upper())
    w = Window.partitionBy("session_name").orderBy("pane_id", "sequence")
    return (entries.where(cond)
            .withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= per_session)
            .select("session_name", "rank", "id", "pane_id", "sequence",
                    F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
                             F.lit("] "), F.col("raw_content")).alias("line")))


def entries_query(entries: DataFrame, since: dt.datetime | None = None,
                  until: dt.datetime | None = None, severity: str | None = None,
                  service: str | None = None) -> DataFrame:
    """F8: conjunction of inclusive time bounds, case-blind severity and exact service."""
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col("timestamp") >= F.lit(since))
    if until is not None:
        cond = cond & (F.col("timestamp") <= F.lit(until))
    if severity is not None:
        cond = cond & (F.col("severity") == severity.upper())
    if service is not None:
        cond = cond & (F.col("service") == service)
    return entries.where(cond)


def entries_since(entries: DataFrame, since: dt.datetime) -> DataFrame:
    """F5."""
    return entries.where(F.col("timestamp") >= F.lit(since))


def by_severity(entries: DataFrame, level: str) -> DataFrame:
    """exact level."""
    return entries.where(F.col("severity") == level)


def by_pane(entries: DataFrame, pane_id: str) -> DataFrame:
    """F7."""
    return entries.where(F.col("pane_id") == pane_id)


def severe_only(entries: DataFrame) -> DataFrame:
    """ERROR or FATAL."""
    return entries.where(F.col("severity").isin("ERROR", "FATAL"))


def min_severity_known(entries: DataFrame, min_level: str) -> DataFrame:
    """at least ``min_level`` and not UNKNOWN."""
    return entries.where(F.col("sev_rank").between(RANK[min_level], RANK["FATAL"]))


def min_severity(entries: DataFrame, min_level: str, include_unknown: bool = True) -> DataFrame:
    """Rank threshold; UNKNOWN ranks highest and passes unless excluded."""
    cond = F.col("sev_rank") >= RANK[min_level]
    if not include_unknown:
        cond = cond & (F.col("severity") != "UNKNOWN")
    return entries.where(cond)


def active_only(df: DataFrame) -> DataFrame:
    """status Active (incidents, alerts)."""
    return df.where(F.col("status") == "Active")


def affecting_service(incidents: DataFrame, service: str) -> DataFrame:
    """incidents whose affected services contain ``service``."""
    return incidents.where(F.array_contains("affected_services", service))
