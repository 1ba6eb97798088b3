"""Severity vocabulary, ranks and the keyword classifier (all JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for identical results) --------
# Ordered levels; UNKNOWN ranks highest, so ">= level" tests pass it.
LEVELS = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN"]
# Accepted spellings of each level (compared upper-cased).
LEVEL_ALIASES = {
    "TRACE": ["TRACE", "TRC"],
    "DEBUG": ["DEBUG", "DBG"],
    "INFO": ["INFO", "INF"],
    "WARN": ["WARN", "WARNING", "WRN"],
    "ERROR": ["ERROR", "ERR"],
    "FATAL": ["FATAL", "CRITICAL", "CRIT"],
}
# Keyword classifier for free text: first group with a lower-cased substring hit wins.
KEYWORD_CLASSES = [
    ("FATAL", ["fatal", "panic", "crash", "sigsegv", "sigkill"]),
    ("ERROR", ["error", "exception", "fail", "failed", "errno", "econnrefused",
               "econnreset", "eaddrnotavail"]),
    ("WARN", ["warn", "warning", "deprecated", "caution"]),
    ("INFO", ["info", "[inf]"]),
    ("DEBUG", ["debug", "[dbg]", "[debug]"]),
    ("TRACE", ["trace", "[trc]"]),
]
# --------------------------------------------------------------------------

RANK = {name: i for i, name in enumerate(LEVELS)}


def _alias_map() -> Column:
    pairs = []
    for level, words in LEVEL_ALIASES.items():
        for w in words:
            pairs += [F.lit(w), F.lit(level)]
    return F.create_map(*pairs)


def normalize_level(c: Column) -> Column:
    """Level word -> canonical level; anything else UNKNOWN; NULL stays NULL.

    A map lookup references ``c`` once, so the expression stays small when
    the optimizer substitutes ``c`` (a nested CASE would copy it per branch).
    """
    return F.coalesce(F.try_element_at(_alias_map(), F.upper(c)),
                      F.when(c.isNotNull(), F.lit("UNKNOWN")))


def sev_rank(c: Column) -> Column:
    """Canonical level -> 0..6 (UNKNOWN = 6); one reference to ``c``."""
    pos = F.array_position(F.array(*[F.lit(x) for x in LEVELS[:-1]]), c)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(RANK["UNKNOWN"])).cast("int")


def classify_keywords(text: Column) -> Column:
    """Keyword severity of a free-text line (substring cascade, case-blind)."""
    low = F.lower(text)
    expr = None
    for level, words in KEYWORD_CLASSES:
        cond = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        expr = F.when(cond, F.lit(level)) if expr is None else expr.when(cond, F.lit(level))
    return expr.otherwise(F.lit("UNKNOWN"))


def level_argument(name: str | None, default: str = "ERROR") -> str:
    """A user-supplied minimum level; unrecognised or empty gives ``default``."""
    if not name:
        return default
    up = name.strip().upper()
    for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"):
        if up == level or (level == "WARN" and up == "WARNING"):
            return level
    return default


def rank_of(level: str) -> int:
    return RANK[level]
