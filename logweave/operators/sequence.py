"""Dense per-key row numbers without funnelling a key through one task.

``row_number() over (partition by k order by o)`` puts every row of a key in
one task; a key holding a third of the data would then be sorted by a single
core.  Here the order is cut into chunks by a column that never decreases
along the order (for log lines: the hour of arrival).  Rows are numbered
inside ``(k, chunk)`` in parallel, and a small table of per-chunk counts
(one row per key and chunk) supplies the offsets.  A chunk of one pane holds
at most one hour of one source's output, however large the table grows.
Everything is a deterministic function of the data, so a lost task recomputes
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys (``<=>``), keeping
    one copy of each key column."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def number_rows(df: DataFrame, part_cols: list[str], order_cols: list[str],
                chunk: Column, name: str = "sequence") -> DataFrame:
    """Add ``name`` = 1-based position of each row within ``part_cols``.

    ``chunk`` must be non-decreasing along ``order_cols`` within a key, and
    ``order_cols`` must be a total order inside a key.
    """
    tagged = df.withColumn("_chunk", chunk)
    keys = [*part_cols, "_chunk"]
    local = tagged.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)))
    # chunk sizes from the numbered rows: same partitioning as the window,
    # so the source is read and shuffled once
    counts = local.groupBy(*keys).agg(F.max("_local").cast("long").alias("_n"))
    before = Window.partitionBy(*part_cols).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = join_keys(local, offsets, keys)
    return (out.withColumn(name, F.col("_local") + F.col("_before"))
            .drop("_chunk", "_local", "_before"))


def arrival_positions(df: DataFrame, text: str, name: str = "_pos") -> DataFrame:
    """Add the 1-based place of each line in its (session, pane) by arrival:
    ``sequence`` may have gaps or repeat (a capture restarts its counter)."""
    order = ["received_at", "sequence", text]
    return number_rows(df, ["session_name", "pane_id"], order, F.date_trunc("hour", F.col("received_at")), name)
