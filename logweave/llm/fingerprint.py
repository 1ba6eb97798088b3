"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is a multiset of paragraphs: the pieces between line breaks, long ones
cut further where white space follows a mark (the end of a clause).  Each is
hashed to a wide vector, and the fingerprint is the sum of these vectors, each
entry modulo a power of two, so it does not depend on the order of the
paragraphs, equal multisets have equal fingerprints, and a paragraph is
inserted or deleted by adding or subtracting its vector (``add``, ``subtract``).

A fingerprint is an array of 30 bigints: 8 sums of 32-bit hash words modulo
2^32 (256 bits, for equality), 21 words with three counters each modulo 2^20
(63 counters: how many paragraphs have a certain hash bit set), and the number
of paragraphs modulo 2^20.  A counter's distance from half the paragraphs is a
sum of random signs, so squares of differences estimate the paragraphs by
which two texts differ; ``likeness`` is one minus their share, between 0 and 1.

Everything is built-in functions; a row needs no other row, except for the
edit of ``edit_with_next``, where documents are dealt out in ranges of the key
(bounds from quantiles) and each takes its neighbour's text from a window; the
last of a range takes the first of the next one by a join.

Defined cases: a NULL text is empty, the empty fingerprint is all zeros;
two empty fingerprints are alike (1), an empty and another are not (0); a NULL
key is smaller than any other; rows of one key are in the order of their
texts; other columns stay.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import join_on

LANES = 4
WORDS = 21
M32 = 0xFFFFFFFF
ONES = 1 | 1 << 21 | 1 << 42
M20 = ONES * 0xFFFFF
CARRY = ONES << 20
CUT = r"\n+|(?<=[^\p{L}\p{N}\s])\s+"
ROWS = 512


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, CUT, -1), lambda p: p != "")


def with_fingerprints(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds a fingerprint column for each text column: ``{text: name}``."""
    def hashes(t):
        def salted(salt):
            return F.transform(f"_p_{t}", lambda x: F.xxhash64(x, F.lit(salt)))

        return [*[salted(i).alias(f"_h{i}_{t}") for i in range(LANES)], salted("count").alias(f"_c_{t}")]

    def total(hs, value, mask):
        return F.aggregate(hs, F.lit(0).cast("long"), lambda acc, h: (acc + value(h)).bitwiseAND(mask))

    def lanes(t):
        out = []
        for i in range(LANES):
            out += [total(f"_h{i}_{t}", lambda h: h.bitwiseAND(M32), M32),
                    total(f"_h{i}_{t}", lambda h: F.shiftrightunsigned(h, 32), M32)]
        out += [total(f"_c_{t}", lambda h, s=s: F.shiftrightunsigned(h, s).bitwiseAND(ONES), M20)
                for s in range(WORDS)]
        return F.array(*out, F.size(f"_c_{t}").cast("long").bitwiseAND(0xFFFFF))

    own = df.columns
    d = df.select("*", *[_paragraphs(F.coalesce(F.col(t), F.lit(""))).alias(f"_p_{t}") for t in columns])
    d = d.select(*own, *[c for t in columns for c in hashes(t)])
    return d.select(*own, *[lanes(t).alias(name) for t, name in columns.items()])


def _combine(a: Column, b: Column, minus: bool) -> Column:
    out = []
    n = 2 * LANES
    for i in range(n + WORDS + 1):
        x, y = F.get(a, i), F.get(b, i)
        mask, carry = (M32, M32 + 1) if i < n else (M20, CARRY) if i < n + WORDS else (0xFFFFF, 1 << 20)
        out.append((x + F.lit(carry) - y if minus else x + y).bitwiseAND(mask))
    return F.array(*out)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of both."""
    return _combine(a, b, False)


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return _combine(a, b, True)


def _signs(fp: Column) -> Column:
    """Twice each counter less the number of paragraphs."""
    words = F.slice(fp, 2 * LANES + 1, WORDS)
    flat = F.flatten(F.transform(words, lambda w: F.array(
        *[F.shiftrightunsigned(w, 21 * k).bitwiseAND(0xFFFFF) for k in range(3)])))
    n = F.element_at(fp, -1)
    return F.transform(flat, lambda c: c * 2 - n)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common paragraphs (by squared multiplicity), 0 to 1."""
    def squares(x):
        return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v)

    sa, sb = _signs(a), _signs(b)
    apart = squares(F.zip_with(sa, sb, lambda x, y: x - y))
    size = squares(sa) + squares(sb)
    return (F.when(a == b, F.lit(1.0)).when(size == 0, F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), 1.0 - apart / size)))


def as_text(fp: Column) -> Column:
    """Hexadecimal form of a fingerprint."""
    n = 2 * LANES
    short = F.transform(F.slice(fp, 1, n), lambda v: F.lpad(F.lower(F.hex(v)), 8, "0"))
    wide = F.transform(F.slice(fp, n + 1, WORDS + 1), lambda v: F.lpad(F.lower(F.hex(v)), 16, "0"))
    return F.concat(F.array_join(short, ""), F.array_join(wide, ""))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = "next_text") -> DataFrame:
    """(key, text, name): the text of the next document in descending order of
    the key; after the last comes the first.

    Rows are dealt out in key ranges of about ``ROWS`` documents whose bounds
    are quantiles, known before the shuffle, and the last document of a range
    takes the first of the next range, a table of one row a range.
    """
    docs = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text),
                     F.coalesce(F.col(key).cast("double"), F.lit(float("-inf"))).alias("_d"))
    parts = min(max(1, df.count() // ROWS), 65536)
    cuts = [] if parts == 1 else df.select(F.col(key).cast("double").alias("_d")).approxQuantile(
        "_d", [i / parts for i in range(1, parts)], max(1e-5, 0.2 / parts))
    inf = float("inf")
    splits = [-inf, *sorted(set(cuts) - {inf, -inf}), inf]
    if len(splits) == 2:
        docs = docs.withColumn("_b", F.lit(0))
    else:
        docs = Bucketizer(splits=splits, inputCol="_d", outputCol="_b").transform(docs).withColumn(
            "_b", F.col("_b").cast("int"))
    # the first document of each range: the greatest key, the least text of it
    top = materialize(join_on(docs, docs.groupBy("_b").agg(F.max(key).alias(key)), ["_b", key], "left_semi")
                      .groupBy("_b").agg(F.min(text).alias("_head")))
    # the window orders the numbers of the ranges only; a join brings the texts
    order = Window.orderBy(F.desc("_b"))
    follows = top.select("_b", F.coalesce(F.lead("_b").over(order), F.first("_b").over(order)).alias("_n"))
    heads = follows.join(top.select(F.col("_b").alias("_n"), "_head"), "_n").select("_b", "_head")
    by = Window.partitionBy("_b").orderBy(F.col(key).desc_nulls_last(), text)
    inner = docs.select(key, text, "_b", F.lead(text).over(by).alias("_lead"))
    return (inner.join(heads, "_b").select(key, text, F.coalesce("_lead", "_head").alias(name)))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first
    characters of ``following``, or all of them if there are fewer."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))

