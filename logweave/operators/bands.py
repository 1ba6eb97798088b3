"""Near pairs of 64-bit hashes inside band buckets.

Two hashes within three bits agree on one of four 16-bit bands and, of the other 48 bits, on one of
four 12-bit blocks.  Spark shuffles every hash once a band, under (scope, band, its 16 bits); a task
sorts the hashes of its buckets by band and block (numpy, whole buckets of some Arrow batches at
once) and compares neighbours of 28 common bits, so that only near pairs leave it, each once: under the
first key that the two share.  A bucket of more than ``BUCKET_ROWS`` hashes is spread by its 28-bit
keys before the shuffle; a group of 28 common bits with more than ``cap`` hashes is split by 9-bit blocks of the other
36 (exact again by pigeonhole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BUCKET_ROWS = 100_000
CHUNK_ROWS, OUT_ROWS = 400_000, 200_000
PAIRS = "_sid long, src long, dst long, src_h long, dst_h long"


def key_masks() -> list[tuple[int, list[int]]]:
    """For each of the 16 tables (band, block) the bits its key covers, and those with each further block,
    as 64-bit masks (bits numbered from the highest)."""
    bands = [list(range(16 * i, 16 * i + 16)) for i in range(4)]
    masks = []
    for i in range(4):
        rest = [p for k in range(4) if k != i for p in bands[k]]
        for j in range(4):
            key = bands[i] + rest[12 * j:12 * j + 12]
            left = rest[:12 * j] + rest[12 * j + 12:]
            masks.append((sum(1 << (63 - p) for p in key),
                          [sum(1 << (63 - p) for p in key + left[9 * m:9 * m + 9]) for m in range(4)]))
    return masks


BAND_MASKS = [0xFFFF << (48 - 16 * i) for i in range(4)]


def masked(mask: int):
    """The bits of ``h`` under a mask, as a (signed) long."""
    return F.col("h").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def bucket_rows(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """``nodes`` (a table with _sid and h) once for each of their buckets (_t, _k): bands 0 to 3, or tables
    4 to 19 in place of a band whose bucket has more than ``most`` rows."""
    most = BUCKET_ROWS if most is None else most
    bands = F.array(*[F.struct(F.lit(i).alias("t"), masked(m).alias("k")) for i, m in enumerate(BAND_MASKS)])
    rows = nodes.select("*", F.explode(bands).alias("_b")).select(*nodes.columns, F.col("_b.t").alias("_t"), F.col("_b.k").alias("_k"))
    keys = ["_sid", "_t", "_k"]
    # at most 4 * 2^16 buckets a scope: the counts shrink before the shuffle
    big = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).drop("_n"))
    if big.isEmpty():
        return rows
    masks = F.array(*[masked(m) for m, _ in key_masks()])
    tables = F.array(*[F.struct((F.col("_t") * 4 + 4 + j).alias("t"), F.element_at(masks, F.col("_t") * 4 + j + 1).alias("k"))
                       for j in range(4)])
    own = F.array(F.struct(F.col("_t").alias("t"), F.col("_k").alias("k")))
    rows = rows.join(big.withColumn("_big", F.lit(True)), keys, "left")
    rows = rows.withColumn("_b", F.explode(F.when(F.col("_big"), tables).otherwise(own)))
    return rows.select(*nodes.columns, F.col("_b.t").alias("_t"), F.col("_b.k").alias("_k"))


def _walk(h: np.ndarray, begin: np.ndarray, stop: np.ndarray, skip: list[int], distance: int):
    """Places (row, other) of near hashes, ``other`` from ``begin`` to ``stop`` of the row."""
    rows, d = np.flatnonzero(begin < stop), 0
    while len(rows):
        other = begin[rows] + d
        x = h[rows] ^ h[other]
        near = np.flatnonzero(np.bitwise_count(x) <= distance)
        for mask in skip:  # the pair belongs to an earlier key
            near = near[x[near] & np.uint64(mask) != 0]
        if len(near):
            yield rows[near], other[near]
        d += 1
        rows = rows[begin[rows] + d < stop[rows]]


def _grouped(h, sid, known, rows, mask: int, split: list[int], skip: list[int], cap: int | None, distance: int):
    """Near pairs among ``rows`` that agree on scope and mask (with ``known``: of a row and a known one)."""
    key = h[rows] & np.uint64(mask)
    order = np.lexsort((key, sid[rows]) if known is None else (~known[rows], key, sid[rows]))
    rows, key = rows[order], key[order]
    change = np.flatnonzero((key[1:] != key[:-1]) | (sid[rows[1:]] != sid[rows[:-1]])) + 1
    heads = np.concatenate(([0], change))
    sizes = np.diff(np.append(heads, len(rows)))
    alone = np.repeat(sizes == 1, sizes)
    rows, heads, sizes = rows[~alone], heads[sizes > 1], sizes[sizes > 1]
    if not len(rows):
        return
    heads = np.cumsum(sizes) - sizes
    if known is None:
        span = sizes
        begin, stop = np.arange(len(rows)) + 1, np.repeat(heads + sizes, sizes)
    else:
        k = known[rows]
        span = np.add.reduceat(k.astype(np.int64), heads)
        begin = np.repeat(heads, sizes)
        stop = np.where(k, begin, begin + np.repeat(span, sizes))
    if split and cap is not None and (span > cap).any():
        crowded = np.repeat(span > cap, sizes)
        stop = np.where(crowded, begin, stop)
        for m, block in enumerate(split):
            yield from _grouped(h, sid, known, rows[crowded], block, [], skip + split[:m], cap, distance)
    for a, b in _walk(h[rows], begin, stop, skip, distance):
        yield rows[a], rows[b]


def _chunk_pairs(c: dict[str, np.ndarray], cross: bool, cap: int | None, distance: int, masks):
    h, sid, at, known = c["h"].view(np.uint64), c["_sid"], c["_at"], c["_known"].astype(bool) if cross else None
    for t in np.unique(c["_t"]):
        rows = np.flatnonzero(c["_t"] == t)
        for table in range(4 * t, 4 * t + 4) if t < 4 else [t - 4]:
            mask, blocks = masks[table]
            for a, b in _grouped(h, sid, known, rows, mask, blocks, [m for m, _ in masks[:table]], cap, distance):
                if cross:
                    a, b = b, a
                else:
                    swap = at[a] > at[b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield sid[a], at[a], at[b], c["h"][a], c["h"][b]


def _pairs_in_buckets(cross: bool, cap: int | None, distance: int):
    names = ["_sid", "_at", "h", "_t", "_k", *(["_known"] if cross else [])]
    masks = key_masks()
    out_names = [f.strip().split(" ")[0] for f in PAIRS.split(",")]

    def chunks(batches) -> Iterator[dict[str, np.ndarray]]:
        held, rows, limit = [], 0, CHUNK_ROWS
        for batch in batches:
            held.append({n: batch.column(n).to_numpy(zero_copy_only=False) for n in names})
            rows += batch.num_rows
            if rows < limit:
                continue
            c = {n: np.concatenate([x[n] for x in held]) for n in names}
            new = (c["_k"][1:] != c["_k"][:-1]) | (c["_sid"][1:] != c["_sid"][:-1]) | (c["_t"][1:] != c["_t"][:-1])
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            if cut:
                yield {n: v[:cut] for n, v in c.items()}
            held, rows = [{n: v[cut:] for n, v in c.items()}], rows - cut
            limit = max(CHUNK_ROWS, 2 * rows)
        if rows:
            yield {n: np.concatenate([x[n] for x in held]) for n in names}

    def run(batches):
        found, n = [], 0
        for c in chunks(batches):
            for part in _chunk_pairs(c, cross, cap, distance, masks):
                found.append(part)
                n += len(part[0])
                if n >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=out_names)
                    found, n = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=out_names)
    return run


def near_pairs(nodes: DataFrame, distance: int, cap: int | None, cross: bool = False) -> DataFrame:
    """(_sid, src, dst, src_h, dst_h) of hashes of one scope within ``distance`` bits.  ``nodes``, a table
    (_sid, _at, h), gives for each two different hashes the smaller ``_at`` as ``src``; with ``cross`` (and a column
    ``_known``) every known one as ``src`` of those that are not, equal hashes too."""
    keys = ["_t", "_sid", "_k"]
    rows = bucket_rows(nodes).repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(_pairs_in_buckets(cross, cap, distance), PAIRS)
