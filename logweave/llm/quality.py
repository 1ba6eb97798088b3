"""Quality classifier trained on preference pairs (Bradley-Terry).

Each text becomes a few figures about its characters, words and lines (never
its label, language, source or id).  Of the labelled rows outside the held-out
fold, every poor text is paired with several good ones; the probability that
the good one is preferred is the logistic function of the difference of their
scores, a linear function of the figures, and the weights maximise the
likelihood of all pairs (Newton steps, small ridge).  The score that the given
share of the fitted texts exceeds is the threshold; scores are moved so that
this quantile is 0 and pass the logistic function, so 0.5 is the threshold.

All labelled rows outside the held-out fold are fitted, one row an id.  Up to ``FIT_ROWS`` of them their
figures, a few numbers a row, are fitted on the driver.  More are dealt into buckets by a hash of the id
(``fit_buckets``): pairs are drawn inside a bucket, every Newton step adds the buckets' gradients and
Hessians, and the threshold is the exact quantile of all scores.

Defined cases: a NULL or empty text has all figures 0 and gets the score of
that row; without labels of both kinds every score is 0.5; repeated rows get
equal scores; other columns stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import label_sample, text_slices

FIT_ROWS = 20_000
PAIRS = 8
FIGURES = ["upper", "digit", "mark", "odd_mark", "shout", "bar", "bare_word", "marked_word", "word_length", "distinct_words",
           "top_word", "repeated_lines", "repeated_words", "short_words", "line_length", "size", "stops"]
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_MARK = bytes(b for b in range(33, 127) if bytes([b]) not in _LETTER and b not in _DIGIT and b not in _LETTER)
_ODD = b"#$%&*<>=~^_\\{}[]@+|"


def _count(t: bytes, chars: bytes) -> int:
    return len(t) - len(t.translate(None, chars))


def figures(t: bytes) -> list[float]:
    """The figures of a UTF-8 text, all between 0 and about 1."""
    words = t.split()
    if not words:
        return [0.0] * len(FIGURES)
    n, nw = len(t), len(words)
    letters = max(1, _count(t, _LETTER))
    lines = [x for x in t.split(b"\n") if x.strip()]
    counts = Counter(words)
    again = Counter(zip(words, words[1:], words[2:]))
    shingles = max(1, nw - 2)
    marked = sum(c for w, c in counts.items() if w[-1] in _ODD or w.endswith(b"!!"))
    bare = sum(c for w, c in counts.items() if not w.translate(None, _MARK + _DIGIT))
    return [
        _count(t, _UPPER) / letters, _count(t, _DIGIT) / n, _count(t, _MARK) / n, _count(t, _ODD) / n,
        t.count(b"!") / n, t.count(b"|") / nw, bare / nw, marked / nw, min(2.0, n / nw / 20),
        len(counts) / nw, max(counts.values()) / nw,
        1 - len(set(lines)) / max(1, len(lines)), 1 - len(again) / shingles if nw > 2 else 0.0,
        sum(c for w, c in counts.items() if len(w) <= 3) / nw, min(2.0, n / max(1, len(lines)) / 500),
        np.log1p(n) / 12, _count(t, b".,") / nw]


def with_figures(df: DataFrame, text: str = "text", name: str = "figures") -> DataFrame:
    """Adds the figures (array<double>) of ``text``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            rows = pa.array([figures(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


class Model:
    """Score of a text: the logistic function of weights . z + shift, z the
    standardised figures and their squares, held to +-4."""

    def __init__(self, mean, std, weights, shift):
        self.mean, self.std, self.weights, self.shift = mean, std, weights, shift

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        return np.concatenate([z, z * z], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights


def fit(x: np.ndarray, y: np.ndarray, share: float | None = None, pairs: int = PAIRS, ridge: float = 1e-3) -> Model:
    """Weights from preference pairs of the rows of ``x``; ``share`` is the
    part of the rows that is to pass (the labels' own part if not given)."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    m = Model(mean, np.where(std > 1e-12, std, 1.0), np.zeros(2 * x.shape[1]), 0.0)
    z = m.expand(x)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(17)
    few, many = (poor, good) if len(poor) <= len(good) else (good, poor)
    a, b = np.repeat(few, pairs), rng.choice(many, size=len(few) * pairs)
    diff = (z[b] - z[a]) if few is poor else (z[a] - z[b])
    w = m.weights
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        grad = diff.T @ (1 - p) / len(diff) - ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    m.weights = w
    raw = z @ w
    share = float(y.mean()) if share is None else share
    # the quantile, in the middle of the gap between the rows on its sides
    order = np.sort(raw)
    k = int(np.clip(round((1 - share) * len(raw)), 1, len(raw) - 1))
    m.shift = -float(order[k - 1] + order[k]) / 2
    return m


def _blocks(rows: DataFrame) -> DataFrame:
    """A table with a row a bucket: its figures (row by row) and labels, in order of the ids."""
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())),
                           T.StructField("y", T.ArrayType(T.LongType()))])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        x = np.concatenate(pdf["figures"].to_numpy())
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "x": [x], "y": [pdf["y"].to_numpy(dtype=np.int64)]})

    return materialize(rows.groupBy("bucket").applyInPandas(pack, schema))


def _sums(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray, int], np.ndarray | None]) -> np.ndarray | None:
    """The sum over all buckets of ``work(figures, labels, bucket)``, an array of the same size for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                y = batch.column("y")[i].values.to_numpy()
                got = work(batch.column("x")[i].values.to_numpy().reshape(len(y), -1), y, batch.column("bucket")[i].as_py())
                if got is not None:
                    total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])

    parts = blocks.mapInArrow(run, T.StructType([T.StructField("s", T.ArrayType(T.DoubleType()))]))
    at = parts.select(F.posexplode("s")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    return np.array([r["v"] for r in at]) if at else None


def fit_buckets(rows: DataFrame, pairs: int = PAIRS, ridge: float = 1e-3) -> Model:
    """``fit`` of a table (bucket, h, doc_id, y, figures) of any size; the driver sees sums.  The buckets
    are formed once; the steps read them without a shuffle."""
    blocks = _blocks(rows)
    first = _sums(blocks, lambda x, y, _: np.concatenate([[len(y), y.sum()], x.sum(axis=0)]))
    n, good, mean = int(first[0]), first[1], first[2:] / first[0]
    std = np.sqrt(_sums(blocks, lambda x, y, _: ((x - mean) ** 2).sum(axis=0)) / n)
    m = Model(mean, np.where(std > 1e-12, std, 1.0), np.zeros(2 * len(mean)), 0.0)
    few_is_poor = n - good <= good

    def step(x, y, bucket):
        few, many = (np.flatnonzero(y == k) for k in ((0, 1) if few_is_poor else (1, 0)))
        if not len(few) or not len(many):
            return None
        z = m.expand(x)
        a, b = np.repeat(few, pairs), np.random.default_rng([17, bucket]).choice(many, size=len(few) * pairs)
        diff = (z[b] - z[a]) if few_is_poor else (z[a] - z[b])
        p = 1 / (1 + np.exp(-np.clip(diff @ m.weights, -30, 30)))
        return np.concatenate([[len(diff)], diff.T @ (1 - p), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])

    w = m.weights
    for _ in range(30):
        got = _sums(blocks, step)
        if got is None:
            break
        size, k = got[0], len(w)
        move = np.linalg.solve(got[1 + k:].reshape(k, k) / size + ridge * np.eye(k), got[1:1 + k] / size - ridge * w)
        m.weights = w = w + move
        if np.abs(move).max() < 1e-6:
            break

    def raw_of(x: pd.Series) -> pd.Series:
        return pd.Series(m.raw(np.array(x.tolist())))

    raw = materialize(rows.select(F.pandas_udf(raw_of, T.DoubleType())("figures").alias("r")))
    k = int(np.clip(round((1 - good / n) * n), 1, n - 1))
    # the k-th and the next score: exact within a narrow bracket of approximate quantiles
    at = k / n - 0.002, (k + 1) / n + 0.002
    low, high = raw.approxQuantile("r", [max(0.0, at[0]), min(1.0, at[1])], 0.0005)
    low, high = low if at[0] > 0 else -np.inf, high if at[1] < 1 else np.inf
    below = raw.where(F.col("r") < low).count()
    order = raw.where(F.col("r").between(low, high)).groupBy("r").count().orderBy("r").toArrow()
    ends = below + np.cumsum(order.column("count").to_numpy())
    near = order.column("r").to_numpy()
    m.shift = -float(near[np.searchsorted(ends, k)] + near[np.searchsorted(ends, k + 1)]) / 2
    return m


def train(df: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, rows: int | None = None,
          local_rows: int = FIT_ROWS) -> Model | None:
    """Fit on all labelled documents outside the held-out fold (``rows``: on at most so many),
    on the driver if they are at most ``local_rows``."""
    chosen = label_sample(labels, "quality", modulus, held, rows)
    # figures before the join: it moves a few numbers a row, not the texts
    some = with_figures(df.select("doc_id", "text", F.xxhash64("text").alias("_text"))).drop("text")
    some = some.join(chosen.hint("merge"), "doc_id")
    one = F.min_by("figures", F.struct("_text", "figures")).alias("figures")
    got = materialize(some.groupBy("doc_id", "y").agg(one).withColumn("h", F.xxhash64("doc_id")))
    kinds = got.groupBy("y").count().collect()
    if len(kinds) < 2:
        return None
    n = sum(r["count"] for r in kinds)
    if n > local_rows:
        return fit_buckets(got.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(-(-n // local_rows)))))
    got = got.orderBy("h", "doc_id").toArrow()
    return fit(np.array(got.column("figures").to_pylist()), got.column("y").to_numpy())


def score(df: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score (double, 0 to 1; 0.5 and more: good) of ``text``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            if model is None:
                s = np.full(len(texts), 0.5)
            else:
                raw = model.raw(np.array([figures(t) for t in texts]))
                s = 1 / (1 + np.exp(-np.clip(raw + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())],
                                             names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
