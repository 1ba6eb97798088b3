"""Anchored window counts.

Rule per key, rows in ``(ts, tiebreak...)`` order: the first row opens a
window at its time; a later row whose time is more than ``width`` past the
window start opens a new window, otherwise it is counted in the current one
(exactly ``width`` later still counts).  Output per row: ``window_start``,
``window_count`` (position of the row in its window, 1-based) and
``occurrence`` (its position in its key).

No built-in window has this shape (each window start depends on the previous
one).  Two exact plans, chosen per key by a partial count:

* keys of fewer than ``hot_rows`` rows: hash-partition on the key, sort within
  partitions, one ``mapInPandas`` pass that carries the open window across Arrow
  batches (O(1) state a task).  All keys of a batch are folded together: one
  ``searchsorted`` on (key code, time) gives every row's jump, and the windows of
  all keys are walked at once.

* hot keys: their time is cut into chunks, and every step below is a job on (key,
  chunk) or on tables far smaller than the rows.
  1. Rows are numbered in their key (chunk-wise) and written once.
  2. Each chunk gives its transition table: for every row at which a window could
     open first in the chunk, the last window start reached from it.
  3. The row that follows that last window (the first later than its start
     + width) is the entry into a later chunk: the jump table entry -> entry.
  4. Pointer doubling from each key's first row finds the entries really taken, in
     log2(chunks) rounds: a round adds the jumps of all entries known so far
     and squares the table.
  5. Every chunk then knows the window open at its start; rows before its entry
     belong to that one, the rest is folded per (key, chunk) as above.
  A chunk spans a power of two of ``width``, up or down, so that no (key, chunk) holds many more than
  ``chunk_rows`` rows, however long a key goes without a pause.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .sequence import join_keys, number_rows

HOT_KEY_ROWS = 1_000_000
CHUNK_ROWS = 500_000


def fold_times(t: np.ndarray, start: int | None, count: int, width_us: int):
    """Fold sorted times ``t`` (int64 microseconds) of one key, continuing
    the open window ``(start, count)`` (``start`` None: none open).
    Returns per-row window starts and counts and the final ``(start, count)``.
    Jumps window to window with ``searchsorted``."""
    n = len(t)
    starts = np.empty(n, dtype=np.int64)
    counts = np.empty(n, dtype=np.int64)
    i = 0
    if start is not None and n:
        j = int(np.searchsorted(t, start + width_us, side="right"))
        if j:
            starts[:j] = start
            counts[:j] = np.arange(count + 1, count + 1 + j)
            count += j
            i = j
    while i < n:
        start = int(t[i])
        j = i + int(np.searchsorted(t[i:], start + width_us, side="right"))
        starts[i:j] = start
        counts[i:j] = np.arange(1, j - i + 1)
        count = j - i
        i = j
    return starts, counts, start, count


def jumps(codes: np.ndarray, t: np.ndarray, width_us: int) -> np.ndarray:
    """For rows sorted by (code, time) the place of the first row of the same
    code later than ``t + width`` (the end of the code's rows if there is none)."""
    times = np.unique(t)
    step = len(times) + 1
    after = np.searchsorted(times, t + width_us, side="right")
    return np.searchsorted(codes * step + np.searchsorted(times, t), codes * step + after)


def fold_groups(codes: np.ndarray, t: np.ndarray, start: int | None, count: int, width_us: int):
    """Fold the sorted groups of one batch; the first group continues the open window ``(start,
    count)``.  Returns window starts and counts of all rows."""
    n = len(t)
    place = np.arange(n)
    heads = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
    ends = np.append(heads[1:], n)
    carried = int(np.searchsorted(t[:ends[0]], start + width_us, side="right")) if start is not None else 0
    opens = np.zeros(n, dtype=bool)
    jump = jumps(codes, t, width_us)
    cur = heads.copy()
    cur[0] = carried
    while True:
        live = cur < ends
        if not live.any():
            break
        cur, ends = cur[live], ends[live]
        opens[cur] = True
        cur = jump[cur]
    anchor = np.maximum.accumulate(np.where(opens, place, 0))
    starts, counts = t[anchor], place - anchor + 1
    if carried:
        starts[:carried] = start
        counts[:carried] = count + 1 + place[:carried]
    return starts, counts


#: In place of a window start: no window is open.
NO_WINDOW = np.iinfo(np.int64).min


def fold_keys(codes: np.ndarray, t: np.ndarray, start: np.ndarray, count: np.ndarray, width_us: int):
    """Fold rows sorted by (code, time), code ``i`` continuing the open window ``(start[i], count[i])``
    (``NO_WINDOW``: none); all of ``0 .. len(start) - 1`` occur.  Returns window starts and counts of all rows."""
    n, place = len(t), np.arange(len(t))
    heads = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.append(heads[1:], n)
    times = np.unique(t)
    step = len(times) + 1
    packed = codes * step + np.searchsorted(times, t)
    jump = np.searchsorted(packed, codes * step + np.searchsorted(times, t + width_us, side="right"))
    first = heads.copy()  # the first row behind the open window
    on = np.flatnonzero(start != NO_WINDOW)
    first[on] = np.searchsorted(packed, on * step + np.searchsorted(times, start[on] + width_us, side="right"))
    opens = np.zeros(n, dtype=bool)
    cur, end = first, ends
    while True:
        live = cur < end
        if not live.any():
            break
        cur, end = cur[live], end[live]
        opens[cur] = True
        cur = jump[cur]
    anchor = np.maximum.accumulate(np.where(opens, place, 0))
    carried = place < first[codes]
    return (np.where(carried, start[codes], t[anchor]),
            np.where(carried, count[codes] + place - heads[codes] + 1, place - anchor + 1))


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """True where a row's key differs from the row before (NULL equals NULL)."""
    change = np.zeros(len(pdf), dtype=bool)
    for k in keys:
        v, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        change[1:] |= (v[1:] != v[:-1]) & ~(null[1:] & null[:-1])
    return change


def _fold_batches(keys: list[str], ts: str, width_us: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # key of the row before
        start, count, seen = None, 0, 0
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            t = pdf[ts].to_numpy(dtype="datetime64[us]").astype(np.int64)
            codes = np.cumsum(_changes(pdf, keys))
            first = pdf[keys].head(1).reset_index(drop=True)
            if last is None or _changes(pd.concat([last, first]), keys)[1]:
                start, count, seen = None, 0, 0
            starts, counts = fold_groups(codes, t, start, count, width_us)
            heads = np.searchsorted(codes, codes)
            occurrence = np.arange(1, n + 1) - heads + np.where(codes == 0, seen, 0)
            start, count, seen = int(starts[-1]), int(counts[-1]), int(occurrence[-1])
            last = pdf[keys].tail(1).reset_index(drop=True)
            yield pdf.assign(window_start=pd.to_datetime(starts, unit="us"), window_count=counts, occurrence=occurrence)
    return run


WINDOW_FIELDS = [T.StructField("window_start", T.TimestampType(), True), T.StructField("window_count", T.LongType(), True),
                 T.StructField("occurrence", T.LongType(), True)]


def _fold(df: DataFrame, fold_keys: list[str], ts: str, order: list[str], width_us: int,
          num_partitions: int | None) -> DataFrame:
    schema = T.StructType(df.schema.fields + WINDOW_FIELDS)
    parted = (df.repartition(num_partitions, *fold_keys) if num_partitions
              else df.repartition(*fold_keys))
    return (parted.sortWithinPartitions(*fold_keys, ts, *order)
            .mapInPandas(_fold_batches(fold_keys, ts, width_us), schema))


def chunk_length(df: DataFrame, keys: list[str], ts: str, width_us: int, chunk_rows: int) -> int:
    """Microseconds of a chunk: ``width`` times the power of two at which the busiest
    (key, width) stretch comes to about ``chunk_rows`` rows."""
    stretch = F.floor(F.unix_micros(F.col(ts)) / F.lit(width_us))
    most = df.groupBy(*keys, stretch.alias("_b")).count().agg(F.max("count")).first()[0] or 1
    if most <= chunk_rows:
        return width_us << min((chunk_rows // most).bit_length() - 1, 16)
    return max(width_us >> (-(-most // chunk_rows) - 1).bit_length(), 1)


def _transitions(keys: list[str], width_us: int, chunk_us: int):
    """Rows of one (key, chunk): every possible entry row with the last window start reached from it."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos", ignore_index=True)
        t = pdf["_t"].to_numpy()
        jump = jumps(np.zeros(len(t), dtype=np.int64), t, width_us)
        last, inside = np.arange(len(t)), jump < len(t)
        step = np.where(inside, jump, np.arange(len(t)))
        while inside.any():  # pointer doubling inside the chunk
            last, step = step[last], step[step]
            inside = step[last] != last
        entry = int(np.searchsorted(t, int(pdf["_chunk"].iloc[0]) * chunk_us + width_us)) + 1
        out = pdf.head(entry)
        return out.assign(_last_t=t[last[:len(out)]], _last_pos=pdf["_pos"].to_numpy()[last[:len(out)]])
    return run


def _next_entries(table: DataFrame, chunks: DataFrame, keys: list[str], width_us: int, chunk_us: int) -> DataFrame:
    """The jump table (keys, _pos, _next): the first entry row later than ``_last_t`` + width."""
    reach = F.col("_last_t") + F.lit(width_us)
    entry = F.struct(F.col("_chunk").alias("b"), F.col("_t").alias("t"), F.lit(1).alias("kind"), F.col("_pos").alias("p"))
    probe = F.struct(F.floor(reach / F.lit(chunk_us)).alias("b"), reach.alias("t"), F.lit(0).alias("kind"), F.col("_pos").alias("p"))
    both = table.select(*keys, F.explode(F.array(entry, probe)).alias("_e")).select(*keys, "_e.*")
    # from late to early, a probe before rows of its own time: the last row passed is the first later one
    back = Window.partitionBy(*keys, "b").orderBy(F.desc("t"), "kind", F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    found = (both.withColumn("_in", F.last(F.when(F.col("kind") == 1, F.col("p")), ignorenulls=True).over(back))
             .where("kind = 0"))
    # nothing later in that stretch of time: the first row of the next chunk with rows
    points = chunks.select(*keys, F.col("_chunk").alias("b"), F.col("_first").alias("f")).unionByName(
        found.select(*keys, "b").distinct().withColumn("f", F.lit(None).cast("long")))
    later = Window.partitionBy(*keys).orderBy(F.desc("b"), F.asc_nulls_first("f")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = points.withColumn("_ahead", F.last("f", ignorenulls=True).over(later)).where("f IS NULL").drop("f")
    out = join_keys(found, ahead, [*keys, "b"])
    return out.select(*keys, F.col("p").alias("_pos"), F.coalesce("_in", "_ahead").alias("_next")).where("_next IS NOT NULL")


def _reached(jump: DataFrame, keys: list[str], chunks: DataFrame) -> DataFrame:
    """Entries on the way from each key's first row, by pointer doubling."""
    reached = materialize(chunks.groupBy(*keys).agg(F.min("_first").alias("_pos")))
    jump = materialize(jump)
    while True:
        further = materialize(join_keys(reached, jump, [*keys, "_pos"]).select(*keys, F.col("_next").alias("_pos")))
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)
        hop = jump.select(*keys, F.col("_pos").alias("_next"), F.col("_next").alias("_then"))
        jump = materialize(join_keys(jump, hop, [*keys, "_next"]).select(*keys, "_pos", F.col("_then").alias("_next")))


def chunked_windows(df: DataFrame, keys: list[str], ts: str, order: list[str], width_us: int,
                    num_partitions: int | None, chunk_rows: int) -> DataFrame:
    """The plan for hot keys (see module doc)."""
    chunk_us = chunk_length(df, keys, ts, width_us, chunk_rows)
    chunk = F.floor(F.unix_micros(F.col(ts)) / F.lit(chunk_us))
    rows = materialize(number_rows(df, keys, [ts, *order], chunk, "_pos")
                       .withColumns({"_t": F.unix_micros(F.col(ts)), "_chunk": chunk}))
    small = rows.select(*keys, "_chunk", "_pos", "_t")
    chunks = materialize(small.groupBy(*keys, "_chunk").agg(F.min("_pos").alias("_first")))
    if chunk_us > width_us:
        schema = T.StructType(small.schema.fields + [T.StructField("_last_t", T.LongType()), T.StructField("_last_pos", T.LongType())])
        table = materialize(small.groupBy(*keys, "_chunk").applyInPandas(_transitions(keys, width_us, chunk_us), schema))
    else:  # a chunk within one window: a window that opens in it is the last of it
        table = small.withColumns({"_last_t": F.col("_t"), "_last_pos": F.col("_pos")})
    reached = _reached(_next_entries(table, chunks, keys, width_us, chunk_us), keys, chunks)
    taken = join_keys(reached, table, [*keys, "_pos"]).select(
        *keys, "_chunk", F.col("_pos").alias("_entry"), F.struct("_last_t", "_last_pos").alias("_open"))
    known = join_keys(chunks, taken, [*keys, "_chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    known = materialize(known.select(*keys, "_chunk", "_entry", F.last("_open", ignorenulls=True).over(before).alias("_open")))
    placed = join_keys(rows, known, [*keys, "_chunk"])
    opened = F.col("_pos") >= F.col("_entry")
    tail = placed.where(~F.coalesce(opened, F.lit(False)))
    tail = tail.withColumns({"window_start": F.timestamp_micros("_open._last_t"),
                             "window_count": F.col("_pos") - F.col("_open._last_pos") + 1, "occurrence": F.col("_pos")})
    fresh = _fold(placed.where(opened).drop("_t", "_entry", "_open"), [*keys, "_chunk"], ts, ["_pos"], width_us, num_partitions)
    columns = [*df.columns, "window_start", "window_count", "occurrence"]
    return tail.select(columns).unionByName(fresh.withColumn("occurrence", F.col("_pos")).select(columns))


def anchored_windows(df: DataFrame, keys: list[str], ts: str, order: list[str],
                     width_s: float, num_partitions: int | None = None,
                     hot_rows: int = HOT_KEY_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``window_start``, ``window_count`` and ``occurrence`` (see module doc).

    ``df`` should carry only the columns needed downstream (they all travel
    through Arrow); it is read twice (materialise an expensive input first).
    ``order`` breaks ties between equal timestamps; rows equal in it too take any order.
    Keys with at least ``hot_rows`` rows (there are at most rows / ``hot_rows`` of
    them) go by chunks, all others whole; ``hot_rows=0`` cuts every key.
    """
    width_us = int(round(width_s * 1_000_000))
    hot = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
                      .select(*keys, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return _fold(df, keys, ts, order, width_us, num_partitions)
    cold = _fold(join_keys(df, hot, keys, "left_anti"), keys, ts, order, width_us, num_partitions)
    busy = chunked_windows(join_keys(df, hot, keys, "left_semi"), keys, ts, order, width_us, num_partitions, chunk_rows)
    return cold.unionByName(busy)
