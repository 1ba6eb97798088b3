"""Removal of repeated byte strings by distributed prefix doubling.

Every byte that lies in a string of ``LENGTH`` bytes which also starts earlier
(in a smaller doc_id, or earlier in the same document) is removed.  The rank
of a position at some length is the first position that holds the same bytes
of that length; a position repeats when its rank at the full length is not
itself.  Ranks are made at growing lengths, and what is unique at one length
is never looked at again:

1. *32 bytes*.  Inside a task the names of all 32-byte strings of a text come
   from five doublings (1, 2, 4, 8, 16, 32).  Any 100-byte string holds 69 of
   them; the one with the least name, leftmost on ties, is its anchor, so
   equal strings have equal anchors at the same place and only anchors (one
   position in 35) go through the shuffle.  The *block* of an anchor is the
   run of bytes of all strings that it stands for.  Spark sorts the anchors by
   (name, digest of the block, position).  An anchor whose name is unique is
   dropped: none of its strings repeats.  A block that occurs earlier as a
   whole repeats as a whole.  What remains is the first occurrence of each of
   several different blocks around one name.
2. *66 bytes*.  Every 100-byte string around an anchor holds the 34 bytes
   before the anchor or the 34 bytes after it.  Sides that are unique are
   dropped with their strings.
3. *100 bytes*.  The strings left are ranked by a sort; all but the first
   position of each class repeat.

Equality is that of two independent 64-bit digests (the anchor's name and the
digest of the longer string).

Copies within one Arrow batch are folded onto the first before the shuffle,
so a block that many documents share costs a row a batch.  Sorted classes are
streamed (running ranks, spilled to disk by Spark), never gathered in memory.

Defined cases: a NULL text is empty; a text of fewer than ``LENGTH`` bytes
keeps all; a NULL doc_id is smaller than any other; documents of one doc_id
are in the order of a digest of their texts, and rows with the same id and
text are one document that is returned once for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import SLICE_BYTES, join_on, text_slices

LENGTH = 100
GRAM = 32
SIDE = GRAM + (LENGTH - GRAM) // 2
_GROW = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _names(x: np.ndarray) -> np.ndarray:
    """Digests of all strings of 32 bytes, by doubling."""
    h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(28)
    step = 1
    for c in _GROW:
        h = h[:-step] * np.uint64(c) + h[step:]
        h ^= h >> np.uint64(32)
        step *= 2
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def text_anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first string's start, number of strings, anchor's place) of the
    anchors of a text of at least ``LENGTH`` bytes."""
    h = _names(x)
    m, at, step, width = h, np.arange(len(h), dtype=np.int32), 1, LENGTH - GRAM + 1
    while 2 * step <= width:
        right = m[step:] < m[:-step]
        at = np.where(right, at[step:], at[:-step])
        m = np.where(right, m[step:], m[:-step])
        step *= 2
    rest = width - step
    if rest:
        at = np.where(m[rest:] < m[:-rest], at[rest:], at[:-rest])
    start = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    end = np.append(start[1:], len(at))
    place = at[start]
    return h[place], start, end - start, place


#: ``spot`` packs the first string's start, the number of strings, the
#: anchor's distance from the start and ``settled``: less to shuffle, same order.
ANCHORS = "h long, block long, doc_id long, th long, spot long"


def anchors(docs: DataFrame) -> DataFrame:
    """Anchors of ``docs`` (doc_id, th, text).  Settled: the block occurs
    earlier in the same batch of rows; its ``h`` only spreads the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch, texts in text_slices(batches, "text"):
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, t in enumerate(texts):
                if len(t) < LENGTH:
                    continue
                name, start, n, place = text_anchors(np.frombuffer(t, dtype=np.uint8))
                block = np.array([digest(t[a:a + k + LENGTH - 1]) for a, k in zip(start.tolist(), n.tolist())],
                                 dtype=np.uint64)
                for c, v in zip(cols, (name, block, np.full(len(start), i), start, n, place - start)):
                    c.append(v)
            if not cols[0]:
                continue
            name, block, row, start, n, q = (np.concatenate(c) for c in cols)
            null = np.array([d is None for d in ids])[row]
            doc = np.array([0 if d is None else d for d in ids], dtype=np.int64)[row]
            th = ths[row]
            order = np.lexsort((start, th, doc, ~null, block, name))
            settled = np.zeros(len(order), dtype=bool)
            a, b = order[1:], order[:-1]
            again = (name[a] == name[b]) & (block[a] == block[b])
            # the same document read twice is one position, not a repeat
            new = ~((null[a] == null[b]) & (doc[a] == doc[b]) & (th[a] == th[b]) & (start[a] == start[b]))
            first = np.maximum.accumulate(np.where(np.append(True, ~again), np.arange(len(order)), 0))
            moved = np.cumsum(np.append(False, new))
            settled[order] = (moved - moved[first]) > 0
            spread = (doc * 1000003 + start) * np.int64(0x1E3779B97F4A7C15)
            h = np.where(settled, spread, name.view(np.int64))
            spot = (start.astype(np.int64) << 20) | (n << 12) | (q.astype(np.int64) << 4) | settled
            yield pa.RecordBatch.from_arrays([
                pa.array(h), pa.array(np.where(settled, 0, block.view(np.int64))), pa.array(doc, mask=null),
                pa.array(th), pa.array(spot)], names=["h", "block", "doc_id", "th", "spot"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, ANCHORS)


def _keyed(df: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """(doc_id, th, text), and whether ids repeat: ``th`` tells rows of one id
    apart, 0 where all ids differ."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    th = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", th.alias("th"), "text"), repeated


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, packed): texts compressed for the shuffle of a join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                              pa.array([pack(t) for t in texts], pa.binary())],
                                             names=["doc_id", "th", "packed"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, "doc_id long, th long, packed binary")


def _cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the blocks at the places of each document."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("places"))
        for i in range(batch.num_rows):
            text, at = unpack(batch.column(2)[i].as_py()), lists[i].values
            off, n = at.field("off").to_pylist(), at.field("n").to_pylist()
            one = pa.array(np.full(len(off), i))
            yield pa.RecordBatch.from_arrays(
                [at.field("h"), batch.column(0).take(one), batch.column(1).take(one), at.field("off"), at.field("n"),
                 at.field("q"), pa.array([text[a:a + k + LENGTH - 1] for a, k in zip(off, n)], pa.binary())],
                names=["h", "doc_id", "th", "off", "n", "q", "b"])


def _part(data: Column, start: Column, length: int | Column) -> Column:
    """Digest of ``length`` bytes from the 0-based ``start``."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.xxhash64(F.substring(data, start.cast("int") + 1, length.cast("int")))


def repeated_intervals(docs: DataFrame, repeated: bool) -> DataFrame:
    """(doc_id, th, start, end): byte intervals whose union is to be removed."""
    same_block = Window.partitionBy("h", "block").orderBy("doc_id", "th", "spot")
    same_name = Window.partitionBy("h")
    ranked = (anchors(docs)
              .withColumn("nth", F.dense_rank().over(same_block))
              .withColumn("several", F.min("block").over(same_name) != F.max("block").over(same_name)))
    again = (F.col("spot").bitwiseAND(1) == 1) | (F.col("nth") > 1)
    found = materialize(ranked.where(again | F.col("several"))
                        .select(F.when(~again, F.col("h")).alias("h"), "doc_id", "th",
                                F.shiftright("spot", 20).cast("int").alias("off"),
                                F.shiftright("spot", 12).bitwiseAND(255).cast("int").alias("n"),
                                F.when(~again, F.shiftright("spot", 4).bitwiseAND(255).cast("int")).alias("q")))
    whole = found.where("h is null").select(
        "doc_id", "th", F.col("off").alias("start"), (F.col("off") + F.col("n") + (LENGTH - 1)).alias("end"))

    # the first of each of several blocks, with its bytes
    firsts = found.where("h is not null")
    if repeated:
        firsts = firsts.dropDuplicates(["doc_id", "th", "off"])
    places = firsts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "off", "n", "q")).alias("places"))
    blocks = materialize(join_on(_packed(docs), places, ["doc_id", "th"])
                         .mapInArrow(_cut_blocks, "h long, doc_id long, th long, off int, n int, q int, b binary"))
    before = F.when(F.col("q") >= SIDE - GRAM, _part(F.col("b"), F.col("q") - (SIDE - GRAM), SIDE))
    after = F.when(F.col("q") + SIDE <= F.length("b"), _part(F.col("b"), F.col("q"), SIDE))
    sided = blocks.withColumn("before", before).withColumn("after", after)
    names = (sided.select("h", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("before").alias("x")),
        F.struct(F.lit(1).alias("side"), F.col("after").alias("x")))).alias("s"))
        .where("s.x is not null").groupBy("h", "s.side", "s.x").count().where("count > 1"))
    b = names.where("side = 0").select("h", F.col("x").alias("before"), F.lit(True).alias("has_before"))
    a = names.where("side = 1").select("h", F.col("x").alias("after"), F.lit(True).alias("has_after"))
    left = F.col("q") - F.col("s")  # bytes of the string before its anchor
    strings = (sided.join(b, ["h", "before"], "left").join(a, ["h", "after"], "left")
               .where("has_before or has_after")
               .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
               .where((F.col("has_before") & (left >= SIDE - GRAM))
                      | (F.col("has_after") & (left <= LENGTH - SIDE)))
               .select("h", _part(F.col("b"), F.col("s"), LENGTH).alias("x"), "doc_id", "th",
                       (F.col("off") + F.col("s")).alias("off")))
    nth = F.dense_rank().over(Window.partitionBy("h", "x").orderBy("doc_id", "th", "off"))
    single = (strings.withColumn("nth", nth).where("nth > 1")
              .select("doc_id", "th", F.col("off").alias("start"), (F.col("off") + LENGTH).alias("end")))
    return whole.unionByName(single)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs) and the kept bytes of each row."""
    docs, repeated = _keyed(df, key, text)
    cuts = (repeated_intervals(docs, repeated).groupBy("doc_id", "th")
            .agg(F.collect_set(F.struct("start", "end")).alias("cuts")))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def made(ids, out):
            n, removed, spans, kept = zip(*out)
            return pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("cuts"))
            ids, out, size = [], [], 0
            for i in range(batch.num_rows):
                t, v = unpack(batch.column(2)[i].as_py()), lists[i].values
                ids.append(batch.column(0)[i].as_py())
                size += len(t)
                if v is None or not len(v):
                    out.append((len(t), 0, 0, t))
                else:
                    depth = np.zeros(len(t) + 2, dtype=np.int32)
                    np.add.at(depth, v.field(0).to_numpy(), 1)
                    np.add.at(depth, v.field(1).to_numpy(), -1)
                    gone = np.cumsum(depth)[:len(t)] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(t), int(gone.sum()), spans, np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()))
                if size > SLICE_BYTES:
                    yield made(ids, out)
                    ids, out, size = [], [], 0
            if out:
                yield made(ids, out)

    return (join_on(_packed(docs), cuts, ["doc_id", "th"], "left").select("doc_id", "th", "packed", "cuts")
            .mapInArrow(cut, schema))


#: DuckDB SQL for the digests of ``remove_repeats`` over ``documents`` (ids that differ): every
#: 100-byte string by its md5, the first start of each kept, the others' intervals merged.
#: Texts are cut into pieces of 1000 starts, as hexadecimal digits.
SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pieces AS (
  SELECT doc_id, n, c * 1000 AS base, substr(hx, c * 2000 + 1, 2198) AS piece
  FROM (SELECT doc_id, n, hx, unnest(range((n + 999) // 1000)) AS c FROM docs)),
grams AS (
  SELECT doc_id, base + i AS s, md5(substr(piece, 2 * i + 1, 200)) AS g
  FROM (SELECT doc_id, base, piece, unnest(range(least(1000, n - 99 - base))) AS i FROM pieces WHERE n - 99 > base)),
again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, s) AS nth
                         FROM grams) WHERE nth > 1),
runs AS (
  SELECT doc_id, min(s) AS a, max(s) + 100 AS b
  FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run
        FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END
                     AS fresh FROM again))
  GROUP BY doc_id, run),
sizes AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id),
gaps AS (  -- what lies before each run, and after the last
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL SELECT r.doc_id, max(r.b), any_value(d.n) FROM runs r JOIN docs d ON r.doc_id IS NOT DISTINCT FROM d.doc_id
  GROUP BY r.doc_id),
kept AS (
  SELECT g.doc_id, string_agg(substr(d.hx, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS hx
  FROM gaps g JOIN docs d ON g.doc_id IS NOT DISTINCT FROM d.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(z.removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(z.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.hx, d.hx))) AS kept_sha256
FROM docs d LEFT JOIN sizes z ON d.doc_id IS NOT DISTINCT FROM z.doc_id
LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id
"""
