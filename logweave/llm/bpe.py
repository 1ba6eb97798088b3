"""Byte-level BPE encoding and decoding with numpy matrices.

A text is cut by the pre-tokenizer pattern; every piece is merged on its own.
The pieces of a slice of documents that have not been met yet are sorted into
buckets by length and laid out as padded matrices of token ids, one row per
piece.  In a round every row finds its leftmost pair of least rank by a hashed
pair lookup, merges it, and the row is compacted; only the pairs beside a
merged token are looked up anew.  Where the merged token can
start no pair of lower rank (nearly all tokens), the later occurrences of the
same pair in the row are merged in the same round, which gives the same ids:
they would be the next leftmost minima.  Rows without a known pair leave the
matrix.  A piece that is a token itself is that token, as in the tiktoken
library.

Defined cases: NULL or empty text encodes to no ids and decodes to no bytes;
a byte that has no token of its own is an error in the vocabulary, raised on
the driver; long texts and long pieces are processed whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_slices

#: The white space of the reference tokenizer's regex engine
#: (the Unicode White_Space property), spelt out for Python's.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
CELLS = 1 << 18
CACHE = 300_000
_NONE = np.int32(1 << 30)
_MULT = np.uint64(0x9E3779B97F4A7C15)


def portable_pattern(pattern: str) -> str:
    """The pattern with white-space classes spelt out."""
    out = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?=[{WHITE}]|\\Z)")
    return out.replace(r"\s", f"[{WHITE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Lookup tables of a rank file; their size is fixed by the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        top = max(ranks.values()) + 1
        self.bits = np.uint64(max(1, int(top).bit_length()))
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.token = [b""] * top
        left, right, merged = [], [], []
        for tok, r in ranks.items():
            self.token[r] = tok
            for cut in range(1, len(tok)):
                a, b = ranks.get(tok[:cut]), ranks.get(tok[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        a, b, m = (np.array(x, dtype=np.int64) for x in (left, right, merged))
        # tokens that can start a pair of lower rank: merged one at a time
        self.inverted = np.zeros(top, dtype=bool)
        self.inverted[a[m < a]] = True
        self.inverted[b[m < b]] = True
        key = (a.astype(np.uint64) << self.bits) | b.astype(np.uint64)
        self.shift = np.uint64(64 - max(4, (2 * len(key)).bit_length()))
        size = 1 << int(np.uint64(64) - self.shift)
        self.keys = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.vals = np.full(size, _NONE, dtype=np.int32)
        slot, todo, self.probes = (key * _MULT) >> self.shift, np.arange(len(key)), 0
        while len(todo):  # open addressing, all keys probing together
            self.probes += 1
            s = slot[todo]
            free = self.keys[s] == np.iinfo(np.uint64).max
            first = np.zeros(len(todo), dtype=bool)
            _, at = np.unique(np.where(free, s, np.uint64(size)), return_index=True)
            first[at] = True
            put = free & first
            self.keys[s[put]] = key[todo[put]]
            self.vals[s[put]] = m[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + np.uint64(1)) % np.uint64(size)
        self.mask = np.uint64(size - 1)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pairs (flat arrays), ``_NONE`` where there is none."""
        key = (a.astype(np.uint64) << self.bits) | b.astype(np.uint64)
        slot = (key * _MULT) >> self.shift
        out = np.full(len(key), _NONE, dtype=np.int32)
        here = self.keys[slot]
        open_ = np.flatnonzero(here != np.iinfo(np.uint64).max)
        k, s, here = key[open_], slot[open_], here[open_]
        while len(open_):
            hit = here == k
            out[open_[hit]] = self.vals[s[hit]]
            miss = ~hit
            open_, k, s = open_[miss], k[miss], (s[miss] + np.uint64(1)) & self.mask
            here = self.keys[s]
            some = here != np.iinfo(np.uint64).max
            open_, k, s, here = open_[some], k[some], s[some], here[some]
        return out

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        lens = np.array([len(p) for p in pieces])
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(order):
            width = 2
            while width < lens[order[at]]:
                width *= 2
            end = int(np.searchsorted(lens[order], width, side="right"))
            step = max(1, CELLS // width)
            for lo in range(at, end, step):
                rows = order[lo:min(end, lo + step)]
                self._bucket(pieces, rows, lens[rows], out)
            at = end
        return out

    def _bucket(self, pieces, rows, n, out) -> None:
        width = int(n.max()) if len(n) else 0
        if width == 0:
            for r in rows:
                out[r] = np.zeros(0, dtype=np.int32)
            return
        flat = np.frombuffer(b"".join(pieces[r].ljust(width, b"\0") for r in rows), dtype=np.uint8)
        ids = self.byte_id[flat.reshape(len(rows), width)]
        n = n.copy()
        # rank[i, j]: of the pair that starts at column j; the last column has none
        rank = np.full(ids.shape, _NONE, dtype=np.int32)
        r, c = np.nonzero(np.arange(1, width)[None, :] < n[:, None])
        rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        while True:
            best = rank.min(axis=1)
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[rows[i]] = ids[i, :n[i]]
                keep = ~done
                if not keep.any():
                    return
                rows, n, best = rows[keep], n[keep], best[keep]
                w = int(n.max())
                ids, rank = ids[keep, :w], rank[keep, :w]
            hit = rank == best[:, None]
            idx = np.arange(hit.shape[1])
            # of touching occurrences every second one from the left is merged
            if (hit[:, 1:] & hit[:, :-1]).any():
                last_gap = np.maximum.accumulate(np.where(hit, -1, idx), axis=1)
                hit &= ((idx - last_gap) & 1) == 1
            one = self.inverted[best]
            if one.any():
                leftmost = hit[one].argmax(axis=1)
                hit[one] = False
                hit[np.flatnonzero(one), leftmost] = True
            ids[hit] = np.broadcast_to(best[:, None], hit.shape)[hit]
            live = idx[None, :] < n[:, None]
            live[:, 1:] &= ~hit[:, :-1]
            n = live.sum(axis=1)
            w = int(n.max())
            to = np.arange(w)[None, :] < n[:, None]

            def packed(x, fill):
                y = np.full(to.shape, fill, dtype=x.dtype)
                y[to] = x[live]
                return y

            ids, rank, grown = packed(ids, 0), packed(rank, _NONE), packed(hit, False)
            redo = grown.copy()
            redo[:, :-1] |= grown[:, 1:]
            r, c = np.nonzero(redo)
            rank[r, c] = _NONE
            some = c + 1 < n[r]
            r, c = r[some], c[some]
            rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])


def _encoder(vocab: Vocabulary, pattern: str):
    find = regex.compile(portable_pattern(pattern)).findall
    # the ids of a piece as raw int32: small, and nothing for the collector to track
    cache: dict[str, bytes] = {}
    whole = vocab.ranks
    raw = [np.int32(i).tobytes() for i in range(len(vocab.token))]

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        nonlocal cache
        split = [find(t.decode("utf-8", "replace")) for t in texts]
        if len(cache) > CACHE:
            cache = {}
        new = []
        for p in set().union(*split).difference(cache):
            r = whole.get(p.encode())
            if r is None:
                new.append(p)
            else:
                cache[p] = raw[r]
        for p, ids in zip(new, vocab.merge([p.encode() for p in new])):
            cache[p] = ids.tobytes()
        out = [np.frombuffer(b"".join(map(cache.__getitem__, pieces)), dtype=np.int32) for pieces in split]
        return out

    return encode


def encode_decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text",
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the token ids of ``text`` (array<int>) and the bytes that these
    ids decode to (binary).  All other columns stay; the tables go to the
    workers as one broadcast whose size is the vocabulary's."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary(ranks))
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())),
                           T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        encode = _encoder(vocab, pattern)
        token = vocab.token
        for batch, texts in text_slices(batches, text):
            coded = encode(texts)
            ends = np.cumsum([0] + [len(c) for c in coded]).astype(np.int32)
            flat = np.concatenate(coded) if coded else np.zeros(0, dtype=np.int32)
            back = [b"".join([token[i] for i in c.tolist()]) for c in coded]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.binary())],
                names=[*batch.schema.names, ids, decoded])

    return df.mapInArrow(run, schema)
