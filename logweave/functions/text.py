"""Content normalisation and small text projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: normalisation rules, applied in this order -------------
TIMESTAMP_RULE = (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?",
                  "[TIMESTAMP]")
LINE_RULE = (r":\d+\b", ": [LINE]")
UUID_RULE = (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "[UUID]")
ADDR_RULE = (r"0x[0-9a-fA-F]+", "[ADDR]")
SIGNATURE_RULES = [TIMESTAMP_RULE, LINE_RULE, UUID_RULE]
FULL_RULES = [TIMESTAMP_RULE, LINE_RULE, UUID_RULE, ADDR_RULE]
# Java 17 treats \b as a Unicode word boundary; the lookahead keeps the
# ASCII meaning that RE2 and newer Java share.
_SPARK_PATTERN = {LINE_RULE[0]: r":\d+(?![0-9A-Za-z_])"}
PREFIX_SIGNATURE_CHARS = 100
SOURCE_PANE_CHARS = 8
PREVIEW_CHARS = 120
MAX_CONTENT_BYTES = 10240
TRUNCATION_MARKER = "...[truncated]"
FUTURE_SKEW_SECONDS = 5
# --------------------------------------------------------------------------


def _apply(c: Column, rules) -> Column:
    for pattern, repl in rules:
        c = F.regexp_replace(c, _SPARK_PATTERN.get(pattern, pattern), repl)
    return c


def normalize_full(c: Column) -> Column:
    """Timestamps, line numbers, UUIDs and hex addresses masked (SimHash input)."""
    return _apply(c, FULL_RULES)


def normalize_signature(c: Column) -> Column:
    """Same without the address rule (exact-signature input)."""
    return _apply(c, SIGNATURE_RULES)


def mask_addresses(c: Column) -> Column:
    """What ``normalize_full`` adds to a text that ``normalize_signature`` gave."""
    return _apply(c, [r for r in FULL_RULES if r not in SIGNATURE_RULES])


def exact_signature(c: Column) -> Column:
    """Exact pattern signature = md5 of the signature-normalised text."""
    return F.md5(normalize_signature(c))


def prefix_signature(severity: Column, text: Column) -> Column:
    """Severity ':' first 100 chars of whitespace-flattened lower-case text."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s", " ")))
    return F.concat(severity, F.lit(":"), F.substring(flat, 1, PREFIX_SIGNATURE_CHARS))


def source_label(service: Column, pane_id: Column) -> Column:
    """Service, else ``pane:`` plus the first 8 chars of the pane id."""
    return F.coalesce(service, F.concat(F.lit("pane:"), F.substring(pane_id, 1, SOURCE_PANE_CHARS)))


def preview(text: Column, n: int = PREVIEW_CHARS) -> Column:
    return F.substring(text, 1, n)


def cut_bytes(text: Column, n: Column) -> Column:
    """The longest beginning of ``text`` of at most ``n`` UTF-8 bytes."""
    data = text.cast("binary")

    def inside(i):  # the byte after the first i goes on with a character
        return F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int").between(128, 191)

    n = n.cast("int")
    end = (F.when(n >= F.length(data), n).when(~inside(n), n).when(~inside(n - 1), n - 1)
           .when(~inside(n - 2), n - 2).otherwise(n - 3))
    return F.substring(data, F.lit(1), end).cast("string")
