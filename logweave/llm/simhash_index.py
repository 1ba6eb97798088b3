"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints link at ``MAX_BITS`` or fewer differing bits.  Of six bit blocks
two at least are then equal, so the index has fifteen trees, one for each pair
of blocks; the top nodes of a tree are the values of its two blocks (the
masked bit pattern that all codes below share, with no difference yet).  Below
a top node the codes are in the order of their Gray rank, where neighbours
differ in few bits, cut into leaves, and leaves into upper nodes; each node
keeps the mask of the bits on which all its codes agree.  A search compares
two nodes on the bits that both have fixed and prunes the whole pair as soon as
the differences so far exceed the limit; only leaves that survive are compared
code by code.

Spark sorts the codes by (tree, top node, Gray rank) into ranges, so a crowded
top node is spread over as many tasks as it needs: it is cut into runs of at
most ``RUN`` codes, and a run is a node again, with its own mask, that is
joined with the other runs of its top node where the masks allow a link.  Of
the links found in a run or between two runs a spanning forest is returned,
which joins the same codes, so the output is linear in the codes.  Components
come from alternating star rounds on these edges.

Equal fingerprints are one code with the smallest doc_id, so a group of copies
is one row.

Defined cases: a NULL or blank text has no words and the fingerprint zero,
which links like any other; rows with a NULL doc_id take part, and a component
that has no other id has a NULL component_id; repeated rows are returned as
often as they occur; further columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import components, join_on, text_slices

MAX_BITS = 4
SHINGLE = 4
SEED = 42
RUN = 4096
LEAF = 32
#: six blocks of the 64 bits: (lowest bit, width)
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TREES = list(combinations(range(6), 2))


def text_fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z folded to a-z."""
    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)[:n]
    ends = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, 1 << 14):
        ones += np.unpackbits(h[lo:lo + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """Adds the fingerprint (bigint, the 64 bits as they are) of ``text``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            fp = np.array([text_fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of the codes in the Gray sequence."""
    g = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return g


class Forest:
    """Union of linked codes; yields the links that joined two parts."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def node(codes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """(mask of the bits on which the codes agree, their values)."""
    both, any_ = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
    mask = ~(both ^ any_)
    return mask, both & mask


def _levels(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Masks and values of the nodes over Gray-ordered codes, leaves first;
    a node of a level covers eight of the level below."""
    cut = np.arange(0, len(codes), LEAF)
    both, any_ = np.bitwise_and.reduceat(codes, cut), np.bitwise_or.reduceat(codes, cut)
    out = []
    while True:
        mask = ~(both ^ any_)
        out.append((mask, both & mask))
        if len(both) == 1:
            return out
        cut = np.arange(0, len(both), 8)
        both, any_ = np.bitwise_and.reduceat(both, cut), np.bitwise_or.reduceat(any_, cut)


def search(a: np.ndarray, b: np.ndarray | None, limit: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning links within Gray-ordered ``a`` (``b`` None) or between ``a``
    and ``b``, descending both hierarchies together."""
    other = a if b is None else b
    la, lb = _levels(a), _levels(other)
    top = max(len(la), len(lb))
    la += [la[-1]] * (top - len(la))
    lb += [lb[-1]] * (top - len(lb))
    x, y = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for lev in range(top - 1, -1, -1):
        (ma, va), (mb, vb) = la[lev], lb[lev]
        far = np.bitwise_count((va[x] ^ vb[y]) & ma[x] & mb[y])
        x, y = x[far <= limit], y[far <= limit]
        if b is None:
            x, y = x[x <= y], y[x <= y]
        if lev == 0 or not len(x):
            break
        na, nb = len(la[lev - 1][0]), len(lb[lev - 1][0])
        wa, wb = (8 if na > len(ma) else 1), (8 if nb > len(mb) else 1)
        x2 = (x[:, None] * wa + np.arange(wa)).repeat(wb, axis=1).ravel()
        y2 = np.tile(y[:, None] * wb + np.arange(wb), (1, wa)).ravel()
        ok = (x2 < na) & (y2 < nb)
        x, y = x2[ok], y2[ok]
    forest = Forest(len(a) + (0 if b is None else len(b)))
    shift = 0 if b is None else len(a)
    for i, j in zip(x.tolist(), y.tolist()):
        ca, cb = a[i * LEAF:(i + 1) * LEAF], other[j * LEAF:(j + 1) * LEAF]
        p, q = np.nonzero(np.bitwise_count(ca[:, None] ^ cb[None, :]) <= limit)
        for s, t in zip((p + i * LEAF).tolist(), (q + j * LEAF).tolist()):
            if b is not None or s < t:
                forest.link(s, t + shift)
    return forest.links


_OUT = T.StructType([
    T.StructField("t", T.IntegerType()), T.StructField("k", T.LongType()), T.StructField("first", T.LongType()),
    T.StructField("mask", T.LongType()), T.StructField("bits", T.LongType()),
    T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("a", T.LongType()),
    T.StructField("b", T.LongType())])


def _small_links(key: np.ndarray, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between codes of equal key up to ``LEAF`` places apart, all at once."""
    out_a, out_b = [], []
    for d in range(1, LEAF):
        i = np.flatnonzero(key[d:] == key[:-d])
        if not len(i):
            break
        near = np.bitwise_count(codes[i] ^ codes[i + d]) <= limit
        out_a.append(codes[i[near]])
        out_b.append(codes[i[near] + d])
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _index(limit: int):
    def rows(t, k, codes):
        """A run of a crowded or divided top node."""
        mask, bits = node(codes)
        return {"t": int(t), "k": int(k), "first": int(codes.view(np.int64)[0]), "mask": int(mask.view(np.int64)),
                "bits": int(bits.view(np.int64)), "codes": codes.view(np.int64).tolist(), "a": None, "b": None}

    def edges(a, b):
        return [{"t": None, "k": None, "first": None, "mask": None, "bits": None, "codes": None, "a": p, "b": q}
                for p, q in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("t", pa.int32()), ("k", pa.int64()), ("first", pa.int64()), ("mask", pa.int64()),
                            ("bits", pa.int64()), ("codes", pa.list_(pa.int64())), ("a", pa.int64()),
                            ("b", pa.int64())])
        held: tuple | None = None  # (t, k, codes) of the top node that may go on
        begun = False  # whether the held node began at the start of the range or was cut

        def close(t, k, codes, divided):
            links = search(codes, None, limit) if len(codes) > 1 else []
            out = edges(codes[[p for p, _ in links]], codes[[q for _, q in links]]) if links else []
            return out + ([rows(t, k, codes)] if divided else [])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, k, c = (batch.column(i).to_numpy() for i in range(3))
            c = c.view(np.uint64)
            out = []
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            start, end = np.append(0, cut), np.append(cut, len(t))
            plain = np.ones(len(t), dtype=bool)
            for g in sorted({0, len(start) - 1} | set(np.flatnonzero(end - start > LEAF).tolist())):
                lo, hi = int(start[g]), int(end[g])
                plain[lo:hi] = False
                codes, key = c[lo:hi], (int(t[lo]), int(k[lo]))
                divided = False
                if held is not None:
                    if held[:2] == key:
                        codes, divided = np.concatenate([held[2], codes]), begun
                    else:
                        out += close(*held, begun)
                else:
                    divided = True  # the first node of the range
                held = None
                while len(codes) > RUN:
                    out += close(*key, codes[:RUN], True)
                    codes, divided = codes[RUN:], True
                if g == len(start) - 1:
                    held, begun = (*key, codes), divided
                else:
                    out += close(*key, codes, divided)
            group = np.repeat(np.arange(len(start)), end - start)
            a, b = _small_links(group[plain], c[plain], limit)
            out += edges(a, b)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist(close(*held, True), schema=schema)

    return run


def _between(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            for ca, cb in zip(batch.column(0), batch.column(1)):
                a = ca.values.to_numpy().view(np.uint64)
                b = cb.values.to_numpy().view(np.uint64)
                for p, q in search(a, b, limit):
                    both = np.concatenate([a[[p]], b[[q - len(a)]]]).view(np.int64)
                    out_a.append(int(both[0]))
                    out_b.append(int(both[1]))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                             names=["a", "b"])

    return run


def links(codes: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that span the same
    components as all pairs within ``limit`` bits."""
    if limit > 4:
        raise ValueError("six blocks are complete for up to four bits")

    def block(i):
        lo, width = BLOCKS[i]
        return F.shiftrightunsigned("fp", lo).bitwiseAND((1 << width) - 1)

    keys = F.array(*[F.struct(F.lit(n).alias("t"), F.shiftleft(block(i), 11).bitwiseOR(block(j)).alias("k"))
                     for n, (i, j) in enumerate(TREES)])
    g = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        g = g.bitwiseXOR(F.shiftrightunsigned(g, s))
    tops = (codes.select("fp", g.alias("gray")).select("fp", "gray", F.explode(keys).alias("key"))
            .select(F.col("key.t").alias("t"), F.col("key.k").alias("k"), "fp",
                    F.col("gray").bitwiseXOR(F.lit(-(1 << 63))).alias("gray")))  # unsigned order
    found = materialize(tops.repartitionByRange("t", "k", "gray").sortWithinPartitions("t", "k", "gray")
                        .select("t", "k", "fp").mapInArrow(_index(limit), _OUT))
    runs = found.where("codes is not null").select("t", "k", "first", "mask", "bits", "codes")
    other = runs.select(*[F.col(c).alias(f"{c}_") for c in runs.columns])
    may = F.bit_count(F.col("bits").bitwiseXOR(F.col("bits_")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask_")))
    pairs = (runs.join(other, (F.col("t") == F.col("t_")) & (F.col("k") == F.col("k_")))
             .where((F.col("first") < F.col("first_")) & (may <= limit)).select("codes", "codes_"))
    return (found.where("a is not null").select("a", "b")
            .unionByName(pairs.mapInArrow(_between(limit), "a long, b long")).distinct())


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    limit: int = MAX_BITS) -> DataFrame:
    """``df`` without ``text``, with ``fp`` (bigint), ``component_id``, the
    smallest ``key`` that the row's fingerprint reaches, and ``_root``, the
    smallest fingerprint, which names the component even without a ``key``."""
    coded = materialize(fingerprints(df.select(text, *[c for c in df.columns if c != text]), text, shingle=shingle)
                        .drop(text))
    codes = materialize(coded.groupBy("fp").agg(F.min(key).alias("_least")))
    comp = components(links(codes, limit))
    rooted = materialize(codes.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                         .select("fp", "_least", F.coalesce("root", "fp").alias("_root")))
    # a table of its own, so that the join's sides are plain scans and Spark may split a large component
    least = materialize(rooted.groupBy("_root").agg(F.min("_least").alias("component_id")))
    return join_on(coded, rooted.join(least, "_root").select("fp", "component_id", "_root"), ["fp"])
