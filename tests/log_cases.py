"""Inputs shared by the tests of the log operators."""

SMALL = "/root/testdata/sf0.001"


def lines_df(spark, rows):
    """log_lines from (pane, seq, received_at, raw) tuples; session = 's'."""
    import datetime as dt

    from logweave.streaming.stream import LOG_LINES_SCHEMA
    base = dt.datetime(2024, 1, 15, 10, 0, 0)
    data = [("s", p, q, base + dt.timedelta(seconds=t) if isinstance(t, (int, float)) else t, raw)
            for p, q, t, raw in rows]
    return spark.createDataFrame(data, LOG_LINES_SCHEMA)
