"""Golden rows (FIXTURES.md part D) for the parser, classifier and normalisers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from log_cases import lines_df
from logweave.functions.parse import fields_text, parse_entries
from logweave.functions.severity import classify_keywords, level_argument, normalize_level
from logweave.functions.text import normalize_full, normalize_signature, prefix_signature

KEYWORDS = [
    ("panic: runtime error", "FATAL"), ("Exception in thread main", "ERROR"),
    ("This is deprecated", "WARN"), ("[INF] Server ready", "INFO"), ("[DBG] entering function", "DEBUG"),
    ("[TRC] trace event", "TRACE"), ("Hello world", "UNKNOWN"),
    ("[ERROR] 2024-01-01: crash", "FATAL"), ("Traceback (most recent call last):", "TRACE"),
]


def test_keyword_classifier(spark):
    df = spark.createDataFrame([(t,) for t, _ in KEYWORDS], "t string")
    got = [r[0] for r in df.select(classify_keywords(F.col("t"))).collect()]
    assert got == [e for _, e in KEYWORDS]


def test_level_argument():
    assert level_argument("warning") == "WARN"
    assert level_argument("unknown") == "ERROR"
    assert level_argument("") == "ERROR"


def test_level_words(spark):
    words = ["trc", "DBG", "Info", "warning", "WRN", "err", "critical", "crit", "bogus", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in df.select(normalize_level(F.col("w"))).collect()]
    assert got == ["TRACE", "DEBUG", "INFO", "WARN", "WARN", "ERROR", "FATAL", "FATAL", "UNKNOWN", None]


def parsed(spark, raws):
    rows = [("p", i + 1, i, r) for i, r in enumerate(raws)]
    return {r["raw_content"]: r for r in parse_entries(lines_df(spark, rows)).collect()}


def test_text_rules(spark):
    raws = ["[ERROR] bracketed", "warning: lowercase warning", "plain text",
            "[checkout-service] Order received", "INFO service=payment-gateway Connected",
            "2024-06-20T10:30:00+00:00 ERROR Test", "INFO request_id=123 user=alice action=login"]
    p = parsed(spark, raws)
    assert p["[ERROR] bracketed"]["severity"] == "ERROR"
    assert p["warning: lowercase warning"]["severity"] == "WARN"
    assert p["plain text"]["severity"] == "UNKNOWN"
    assert p["[checkout-service] Order received"]["service"] == "checkout-service"
    assert p["INFO service=payment-gateway Connected"]["service"] == "payment-gateway"
    assert p["2024-06-20T10:30:00+00:00 ERROR Test"]["timestamp"] == dt.datetime(2024, 6, 20, 10, 30)
    assert p["2024-06-20T10:30:00+00:00 ERROR Test"]["ts_source"] == "text_iso"
    kv = p["INFO request_id=123 user=alice action=login"]["parsed_fields"]
    assert kv == {"request_id": "123", "user": "alice", "action": "login"}
    # quirk kept: a bracketed level word is taken as service
    assert p["[ERROR] bracketed"]["service"] == "ERROR"


def test_json_and_logfmt(spark):
    j = '{"level":"ERROR","service":"api","message":"boom","ts":"2024-01-15T10:00:05Z","n":3,"x":null}'
    lf = 'ts=2024-01-15T10:00:06Z level=WARN service=payment msg="high latency" note="a \\"q\\" b"'
    p = parsed(spark, [j, lf, "a= b", 'k="unterminated value'])
    pj, pl = p[j], p[lf]
    assert (pj["severity"], pj["service"]) == ("ERROR", "api")
    assert pj["timestamp"] == dt.datetime(2024, 1, 15, 10, 0, 5) and pj["ts_source"] == "json"
    assert pj["parsed_fields"]["message"] == "boom" and pj["parsed_fields"]["n"] == "3"
    assert pj["parsed_fields"]["x"] == "null" and pj["parsed_fields"]["ts"] == "2024-01-15T10:00:05Z"
    assert (pl["severity"], pl["service"]) == ("WARN", "payment")
    assert pl["parsed_fields"]["msg"] == "high latency"
    assert pl["parsed_fields"]["note"] == 'a "q" b'
    assert p["a= b"]["parsed_fields"]["a"] == "b"
    assert p['k="unterminated value']["parsed_fields"]["k"] == "unterminated value"


def test_reference_cascade_overwrites(spark):
    lf = "[svc-b] ERROR level=info service=a"
    df = lines_df(spark, [("p", 1, 0, lf)])
    fixed = parse_entries(df).first()
    ref = parse_entries(df, cascade="reference").first()
    assert (fixed["severity"], fixed["service"]) == ("INFO", "a")       # structured wins
    assert (ref["severity"], ref["service"]) == ("ERROR", "svc-b")      # text rules overwrite
    assert ref["parsed_fields"] == {"level": "info", "service": "a"}


@pytest.mark.parametrize("raw,full,sig", [
    ("2024-01-15T10:30:00Z ERROR: Failed at File.java:123",
     "[TIMESTAMP] ERROR: Failed at File.java: [LINE]", "[TIMESTAMP] ERROR: Failed at File.java: [LINE]"),
    ("id 550e8400-e29b-41d4-a716-446655440000 at 0x7fff5fbff8a0",
     "id [UUID] at [ADDR]", "id [UUID] at 0x7fff5fbff8a0"),
])
def test_normalisation(spark, raw, full, sig):
    df = spark.createDataFrame([(raw,)], "r string")
    r = df.select(normalize_full(F.col("r")), normalize_signature(F.col("r"))).first()
    assert (r[0], r[1]) == (full, sig)


def test_prefix_signature(spark):
    df = spark.createDataFrame([("ERROR", "  Hello\tWORLD  ")], "s string, r string")
    assert df.select(prefix_signature(F.col("s"), F.col("r"))).first()[0] == "ERROR:hello world"


def test_fields_text_is_sorted(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},)], "m map<string,string>")
    assert df.select(fields_text(F.col("m"))).first()[0] == "a=1\u0001b=2"


def test_custom_named_group_patterns(spark):
    from logweave.functions.parse import custom_pattern_fields
    pats = [r"^(?P<level>[A-Z]+)\|(?P<service>[a-z]+)\|(?P<timestamp>\S+)\|(?P<message>.+)$",
            r"^at (?P<timestamp>[0-9T:-]+), (?P<level>[A-Z]+) - (?P<message>.*)$"]
    df = spark.createDataFrame([("ERROR|api|2024-01-15T10:00:00Z|boom",),
                                ("at 2024-01-15T10:00:00, WARN - slow disk",), ("nothing",)], "r string")
    got = [r[0] for r in df.select(custom_pattern_fields(F.col("r"), pats)).collect()]
    assert got[0].asDict() == {"pattern_index": 0, "timestamp": "2024-01-15T10:00:00Z", "level": "ERROR",
                               "severity": None, "service": "api", "message": "boom"}
    assert (got[1]["pattern_index"], got[1]["level"], got[1]["service"]) == (1, "WARN", None)
    assert got[2] is None


def test_stack_traces_collapse_and_share_a_signature(spark):
    from logweave.operators.multiline import collapse_multiline
    from logweave.functions.text import exact_signature
    def trace(a, b):
        return ["ERROR Unhandled exception java.lang.IllegalStateException: bad state",
                f"    at com.app.Service.run(Service.java:{a})", f"    at com.app.Main.main(Main.java:{b})",
                "Caused by: java.io.IOException: closed"]
    raws = trace(42, 7) + trace(57, 9)
    rows = [("p", i + 1, i + 1, r) for i, r in enumerate(raws)]
    e = parse_entries(lines_df(spark, rows))
    c = collapse_multiline(e).orderBy("group_start").collect()
    assert [(r["group_start"], r["line_count"]) for r in c] == [(1, 4), (5, 4)]
    sigs = spark.createDataFrame([(r["content"],) for r in c], "t string").select(exact_signature(F.col("t"))).collect()
    assert sigs[0][0] == sigs[1][0]          # only line numbers differ


def test_json_values_that_are_not_strings_are_not_read(spark):
    from log_cases import lines_df

    from logweave.functions.parse import parse_entries
    e = parse_entries(lines_df(spark, [
        ("p", 1, 0, '{"level": 5, "service": 7, "msg": "ERROR x"}'),
        ("p", 2, 1, '{"level": "warn", "service": "api", "msg": {"a": 1}}'),
        ("p", 3, 2, '{"severity": null, "component": ["x"], "message": "ok"}')]))
    got = {r["sequence"]: r for r in e.collect()}
    assert (got[1]["severity"], got[1]["service"]) == ("ERROR", None)
    assert (got[2]["severity"], got[2]["service"]) == ("WARN", "api")
    assert got[1]["parsed_fields"]["message"] == "ERROR x" and "message" not in got[2]["parsed_fields"]
    assert (got[3]["severity"], got[3]["service"]) == ("UNKNOWN", None)


def test_each_text_pattern_stands_once_in_the_plan(spark):
    """An expression used twice would run its pattern twice a line, and swell the generated code."""
    from logweave.functions import parse as P
    e = parse_entries(lines_df(spark, [("p", 1, 0, "x")]))
    plan = e._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (P.TS_ISO, P.TS_STANDARD, P.TS_SYSLOG, P.SEVERITY_WORD, P.SERVICE_TAG, P.LOGFMT_PAIR_JAVA):
        assert plan.count(f" {pattern}, ") == 1, pattern
