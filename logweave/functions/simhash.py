"""64-bit SimHash (D2) as an Arrow-batched pandas UDF, Hamming distance (D3).

Tokens are the whitespace-separated words of the text; each token hashes to
the first 8 bytes of its MD5 (big-endian, bit 0 = least significant); every
bit of the result is set iff more tokens have it set than unset.  No tokens
gives 0.  The 64 bits are returned as two non-negative 32-bit halves
``hi`` (bits 63..32) and ``lo`` (bits 31..0) so that every engine handles
them without signed 64-bit trouble.

A batch is taken in slices of bounded length, so long texts do not add up.
Inside a slice each distinct token is hashed once; bits are unpacked with
numpy and summed per row with ``add.reduceat`` in bounded token chunks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: the whitespace that separates tokens ----------------------
# Unicode White_Space code points.
WHITESPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# -----------------------------------------------------------------------------

_SPLIT = re.compile("[" + "".join(re.escape(chr(c)) for c in WHITESPACE) + "]+")
_CHUNK_TOKENS = 1 << 18
_SLICE_CHARS = 1 << 22


def whitespace_class_regex() -> str:
    """The same class for Java / RE2 patterns (``\\x{h}`` escapes)."""
    return "[" + "".join(f"\\x{{{c:X}}}" for c in WHITESPACE) + "]+"


def simhash_halves(texts: pd.Series) -> pd.DataFrame:
    """Plain-pandas SimHash of a batch -> DataFrame(hi, lo), in slices of
    about ``_SLICE_CHARS`` characters."""
    ends = np.cumsum([0 if t is None else len(t) for t in texts], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // _SLICE_CHARS)) + 1).tolist(), len(texts)]
    return pd.concat([_slice_halves(texts.iloc[a:b]) for a, b in zip(cuts, cuts[1:])], ignore_index=True)


def _slice_halves(texts: pd.Series) -> pd.DataFrame:
    n = len(texts)
    vocab: dict[str, int] = {}
    idx: list[int] = []
    lens = np.zeros(n, dtype=np.int64)
    for r, t in enumerate(texts):
        if t is None:
            continue
        k = 0
        for tok in _SPLIT.split(t):
            if tok:
                j = vocab.get(tok)
                if j is None:
                    j = vocab[tok] = len(vocab)
                idx.append(j)
                k += 1
        lens[r] = k
    hi = np.zeros(n, dtype=np.int64)
    lo = np.zeros(n, dtype=np.int64)
    if vocab:
        digest = b"".join(hashlib.md5(tok.encode("utf-8")).digest()[:8] for tok in vocab)
        bits = np.unpackbits(np.frombuffer(digest, dtype=np.uint8).reshape(-1, 8), axis=1,
                             bitorder="big")          # column 0 = bit 63
        tok_idx = np.asarray(idx, dtype=np.int64)
        ends = np.cumsum(lens)
        starts = ends - lens
        ones = np.zeros((n, 64), dtype=np.int64)
        rows = np.flatnonzero(lens > 0)
        # rows in chunks of about _CHUNK_TOKENS tokens
        i = 0
        while i < len(rows):
            j = i
            budget = 0
            while j < len(rows) and (j == i or budget + lens[rows[j]] <= _CHUNK_TOKENS):
                budget += lens[rows[j]]
                j += 1
            chunk = rows[i:j]
            lo_t, hi_t = starts[chunk[0]], ends[chunk[-1]]
            g = bits[tok_idx[lo_t:hi_t]].astype(np.int32)
            offs = starts[chunk] - lo_t
            ones[chunk] = np.add.reduceat(g, offs, axis=0)
            i = j
        set_bits = (2 * ones - lens[:, None]) > 0   # more ones than zeros
        packed = np.packbits(set_bits.astype(np.uint8), axis=1, bitorder="big")  # 8 bytes
        hi = packed[:, :4].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], dtype=np.int64)
        lo = packed[:, 4:].astype(np.int64) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], dtype=np.int64)
    return pd.DataFrame({"hi": hi, "lo": lo})


# an explicit type: the module is also imported by Python workers, where no
# session exists to parse a DDL string
HALVES = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())])


@F.pandas_udf(HALVES)
def simhash(texts: pd.Series) -> pd.DataFrame:
    return simhash_halves(texts)


def hamming(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """D3: popcount of the xor (JVM-side)."""
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def as_long(hi: Column, lo: Column) -> Column:
    """The 64 bits as one (signed) long: a compact join key."""
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def python_simhash(text: str) -> int:
    """Reference implementation for tests (one text, unsigned 64-bit int)."""
    toks = [t for t in _SPLIT.split(text) if t]
    acc = [0] * 64
    for tok in toks:
        h = int.from_bytes(hashlib.md5(tok.encode("utf-8")).digest()[:8], "big")
        for i in range(64):
            acc[i] += 1 if (h >> i) & 1 else -1
    return sum(1 << i for i in range(64) if acc[i] > 0)
