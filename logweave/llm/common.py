"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of the columns ``keys`` of two frames."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, NULL matching NULL; the key columns of ``left`` stay."""
    r = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_right_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"_right_{k}" for k in keys])


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``SLICE_BYTES`` of text (a longer
    text is a slice of its own), with the texts as UTF-8 (NULL: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        start, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            t = col[i].as_py() or b""
            if texts and size + len(t) > SLICE_BYTES:
                yield batch.slice(start, i - start), texts
                start, size, texts = i, 0, []
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(start, len(texts)), texts


def label_sample(labels: DataFrame, target: str, modulus: int, held: int, bound: int | None) -> DataFrame:
    """(doc_id, y) of at most ``bound`` (None: all) labelled rows outside the held-out fold
    (crc32 of the id as text, modulo ``modulus``, equal to ``held``), the
    first in a fixed pseudo-random order of the ids."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (fold != held))
            .groupBy("doc_id").agg(F.max(target).alias("y")))
    return rows if bound is None else rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of comparable ids: (node, root)
    with root the smallest id that the node reaches.

    Alternating large-star and small-star rounds (Kiveris et al., SoCC 2014):
    each round re-points edges to the smallest neighbour, so the edge list
    never grows and becomes stars in O(log^2 n) rounds, few in practice.  The
    smallest neighbour of a node is a partial aggregate; the join back to its
    edges is an equi-join that Spark may split at a busy node.  The edges of
    every round are a table in the shared folder.
    """
    cur = materialize(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                      .where("hi <> lo").distinct())
    seen = None
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .unionByName(down.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct())
        cur = materialize(small)
        # unchanged edge set: compare an order-independent digest
        h = F.xxhash64("hi", "lo")
        digest = cur.agg(F.count(F.lit(1)), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first()
        if digest == seen:
            break
        seen = digest
    nodes = cur.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionByName(cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
