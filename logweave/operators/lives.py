"""Leaders of bounded life (D6, batch form).

A leader takes near-identical lines (at most three bits apart) of its scope up to
``ttl`` after its insertion; a later line opens a cluster of its own, and a line joins the
earliest leader that lives.  Hashes without a near neighbour (almost all) never meet another
leader's life: theirs are anchored windows of one key, also where a key is hot.  Hashes with near
neighbours form families (connected over the near pairs); the lines of a
family are folded in order in one streaming pass.  New leaders are younger than all that live, so a hash keeps
its leader while that one lives: only then a line looks at the hash's near neighbours, which come ahead of the lines.
The state of a family is its hashes, and a line costs no more for the leaders alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .cluster import near_duplicate_pairs, scope_ids, with_sid
from .fold import NO_WINDOW, anchored_windows
from .sequence import join_keys


def families(pairs: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, h, family) of the hashes in ``pairs`` (scope, a, b): the least hash that is
    connected.  A round moves every hash to the least of its neighbours and on to that one's own, and keeps the pairs between
    different places only, so that the graph shrinks by a factor a round, however long its chains are."""
    edges = materialize(pairs.select(*scope, "a", "b").unionByName(pairs.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))))
    label = None
    while True:
        low = materialize(edges.groupBy(*scope, "a").agg(F.least("a", F.min("b")).alias("_m")))
        up = low.select(*scope, F.col("a").alias("_m"), F.col("_m").alias("_to"))
        step = materialize(join_keys(low, up, [*scope, "_m"]).select(*scope, F.col("a").alias("family"), "_to"))
        if label is None:
            label = step.select(*scope, F.col("family").alias("h"), F.col("_to").alias("family"))
        else:
            label = materialize(join_keys(label, step, [*scope, "family"], "left").select(
                *scope, "h", F.coalesce("_to", "family").alias("family")))
        for end in ("a", "b"):
            edges = join_keys(edges, step.withColumnRenamed("family", end), [*scope, end]).drop(end).withColumnRenamed("_to", end)
        edges = materialize(edges.where("a <> b").select(*scope, "a", "b").distinct())
        if edges.isEmpty():
            return label


def _live_fold(names: list[str], ttl_us: int):
    """Streaming fold of families, each first its hashes with their neighbours, then its lines: adds to the
    lines the leader's hash and insertion time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, near, born, led, places = None, {}, {}, {}, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in ("_sid", "family", "_line", "h", "_t", "_near")}
            line = col["_line"].to_numpy(zero_copy_only=False)
            lists = col["_near"]
            values, starts = lists.values.to_numpy(), lists.offsets.to_numpy()
            leader, at = [], []
            for i, (key, is_line, h, now) in enumerate(zip(zip(col["_sid"].to_pylist(), col["family"].to_pylist()), line.tolist(),
                                                           col["h"].to_pylist(), col["_t"].to_pylist())):
                if key != last:
                    last, near, born, led, places = key, {}, {}, {}, 0
                if not is_line:
                    near[h] = values[starts[i]:starts[i + 1]]
                    continue
                own = led.get(h)  # place in the order of insertion, time, leader
                if own is None or own[1] < now - ttl_us:
                    lives = [born[y] for y in (h, *near[h].tolist()) if y in born]
                    own = min((x for x in lives if x[1] >= now - ttl_us), default=None)
                    if own is None:
                        places += 1
                        own = born[h] = (places, now, h)
                    led[h] = own
                leader.append(own[2])
                at.append(own[1])
            if leader:
                kept = batch.select(names).filter(pa.array(line))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(leader, pa.int64()), pa.array(at, pa.int64())],
                                                 names=[*names, "leader", "_led"])
    return run


def leader_lives(codes: DataFrame, scope: list[str], order: list[str], ttl_s: float) -> DataFrame:
    """``codes`` (a table with scope, h, hi, lo, ``timestamp`` and ``order``) with ``leader`` (hash) and
    ``led_at`` (its insertion) of every line's cluster."""
    hashes = materialize(codes.select(*scope, "h", "hi", "lo").distinct())
    pairs = materialize(near_duplicate_pairs(hashes, scope).select(*scope, "a", "b"))
    family = families(pairs, scope)
    alone = join_keys(codes, family.select(*scope, "h"), [*scope, "h"], "left_anti")
    lone = (anchored_windows(alone, [*scope, "h"], "timestamp", order, ttl_s)
            .withColumns({"leader": F.col("h"), "led_at": F.col("window_start")}))
    lines = (join_keys(codes, family, [*scope, "h"])
             .withColumns({"_line": F.lit(True), "_t": F.coalesce(F.unix_micros("timestamp"), F.lit(NO_WINDOW)),
                           "_near": F.lit(None).cast("array<long>")}))
    both = pairs.select(*scope, F.col("a").alias("h"), F.col("b").alias("_b")).unionByName(
        pairs.select(*scope, F.col("b").alias("h"), F.col("a").alias("_b")))
    around = join_keys(both.groupBy(*scope, "h").agg(F.collect_list("_b").alias("_near")), family, [*scope, "h"])
    around = around.withColumns({"_line": F.lit(False), "_t": F.lit(NO_WINDOW)})
    keys = ["_sid", "family"]
    rows = with_sid(lines.unionByName(around, allowMissingColumns=True), scope_ids(hashes, scope), scope)
    schema = T.StructType([*codes.schema.fields, T.StructField("leader", T.LongType()), T.StructField("_led", T.LongType())])
    kin = (rows.repartition(*keys).sortWithinPartitions(*keys, "_line", "timestamp", *order)
           .mapInArrow(_live_fold(codes.columns, int(ttl_s * 1_000_000)), schema)
           .withColumn("led_at", F.when(F.col("_led") != NO_WINDOW, F.timestamp_micros("_led"))))
    columns = [*codes.columns, "leader", "led_at"]
    return lone.select(columns).unionByName(kin.select(columns))
