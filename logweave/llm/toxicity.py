"""Toxicity score from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms and accents are removed, letters
that look like Latin ones become Latin, digits and signs that stand for
letters inside a word become letters, marks become single spaces.  Lexicon
entries are beginnings of words (found after a space), so inflected forms of a
stem are one entry.

The lexicon is learnt from labelled rows outside the held-out fold: for each
beginning of ``STEMS`` letters and each whole word Spark counts the toxic and
the clean documents that hold it; entries whose count among toxic documents
cannot be chance keep their log odds as weight.  Of entries that begin alike
the strongest stays, and a rare entry that is never the strongest of a toxic
document goes (words that only stand beside toxic ones).  Equal texts count once.  Exceptions are phrases of two words that hold an
entry but appear in clean documents at least as often as in toxic ones; a
match inside such a phrase does not count.

The score is the logistic function of a line through two figures, the summed
weight and the weight by length, fitted on the same rows.

``FIT_ROWS`` bounds the labelled rows (the first in a fixed pseudo-random order
of the ids, one text an id), which is what a training set needs, not what the corpus
holds; the lexicon is every entry of theirs that passes.

Defined cases: a NULL or empty text matches nothing; without labels of both
kinds every score is 0; repeated rows get equal scores; other columns stay.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import label_sample, text_slices

FIT_ROWS = 20_000
STEMS = (4, 5, 6, 7)
MIN_DOCS = 3
COMMON = 5
THRESHOLD = 0.3
#: Signs that stand for letters, and letters that look like Latin ones.
LEET = str.maketrans("013457@$!|+", "oieastasiit")
LOOKALIKE = str.maketrans(
    "аеорсухіѕјԁԛһвмтнкгпαεορτυνικχηɑɡıł",
    "aeopcyxisjdqhbmthkrnaeoptuvikxnagil")
_SIGN = "[013457@$]"
_HAS_LEET = regex.compile(rf"(?<=\p{{L}}){_SIGN}++|(?<!{_SIGN}){_SIGN}++(?=\p{{L}})|(?<=\p{{L}})[!|+](?=\p{{L}})")
_OTHER = regex.compile(r"[^\p{L}]+")
_ACCENTS = {i: None for i in range(0x300, 0x370)} | {i: None for i in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}


def fold(text: str) -> str:
    """Folded words, one space before each and one at the end."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_ACCENTS).translate(LOOKALIKE)
    t = _HAS_LEET.sub(lambda m: m.group().translate(LEET), t)
    return " " + _OTHER.sub(" ", t).strip() + " "


def _folded(df: DataFrame, text: str, name: str) -> DataFrame:
    schema = T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, text):
            keep = [i for i, n in enumerate(batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array([fold(t.decode("utf-8", "replace")) for t in texts])],
                names=[*[batch.schema.names[i] for i in keep], name])

    return df.mapInArrow(run, schema)


class Lexicon:
    """Entries (with the space before them) and their weights, exception
    phrases, and the line of the score."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], line=(0.0, 0.0, -30.0)):
        self.weights, self.exceptions, self.line = weights, exceptions, line

    def automaton(self):
        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (len(k), w))
        for p in self.exceptions:
            if p not in self.weights:
                a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def figures(self, automaton, folded: str) -> tuple[float, float]:
        """(summed weight, weight by length) of a folded text."""
        if not len(automaton):
            return 0.0, 0.0
        hits, safe = [], []
        for end, (n, w) in automaton.iter(folded):
            (safe if w is None else hits).append((end - n + 1, end, w))
        if not hits:
            return 0.0, 0.0
        if safe:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in safe)]
        total = sum(w for *_, w in {(h[0]): h for h in sorted(hits)}.values())
        words = folded.count(" ") - 1
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, words)))


def _entries(folded: str) -> set[str]:
    """The distinct words and word beginnings of a folded text."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) > 2}
    for n in STEMS:
        out |= {f" {w[:n]}" for w in words if len(w) > n}
    return out


def _phrases(lex: Lexicon):
    auto = lex.automaton()

    def found(folded: str) -> set[str]:
        out = set()
        for end, (n, _) in auto.iter(folded):
            a = end - n + 1  # the space before the word
            z = folded.index(" ", a + 1)
            if a > 0:
                out.add(folded[folded.rindex(" ", 0, a):z + 1])
            if z + 1 < len(folded):
                out.add(folded[a:folded.index(" ", z + 1) + 1])
        return out

    return found


def _apart(strength: dict[str, float]) -> dict[str, float]:
    """Of entries that begin alike (a word, its beginnings) the strongest."""
    out: dict[str, float] = {}
    begun: set[str] = set()  # all beginnings of the entries kept
    for e in sorted(strength, key=lambda x: (-strength[x], x)):
        word = e.rstrip()
        if any(word[:n + 1] in out for n in (*STEMS, len(word))) or (not e.endswith(" ") and e in begun):
            continue
        out[e] = strength[e]
        begun |= {word[:n + 1] for n in STEMS}
    return out


def _strongest(strength: dict[str, float]):
    auto = Lexicon(strength, []).automaton()

    def found(folded: str) -> set[str]:
        hits = {(v, folded[end - n + 1:end + 1]) for end, (n, v) in auto.iter(folded)}
        return {max(hits)[1]} if hits else set()

    return found


def _counts(docs: DataFrame, make) -> DataFrame:
    """(entry, bad, clean): documents of each kind that hold what ``make()``
    finds in a text; counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = make()

        def flush(bad, clean):
            keys = list(bad.keys() | clean.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()),
                 pa.array([clean[k] for k in keys], pa.int64())], names=["entry", "bad", "clean"])

        bad, clean = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                (bad if y else clean).update(find(t.as_py()))
                if len(bad) + len(clean) > 400_000:
                    yield flush(bad, clean)
                    bad, clean = Counter(), Counter()
        yield flush(bad, clean)

    return (docs.select("y", "folded").mapInArrow(run, "entry string, bad long, clean long")
            .groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean")))


def learn(df: DataFrame, labels: DataFrame, modulus: int = 4, held: int = 2, rows: int = FIT_ROWS) -> Lexicon | None:
    """Lexicon, exceptions and line from labelled documents outside the fold."""
    chosen = label_sample(labels, "toxic", modulus, held, rows)
    # at most ``rows`` ids and labels; of several texts of an id one is learnt from
    one = (df.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y")
           .agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    docs = materialize(_folded(one, "text", "folded").select("doc_id", "y", "folded").dropDuplicates(["folded"]))
    n, bad = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not bad or bad == n:
        return None
    base, seen = bad / n, F.col("bad") + F.col("clean")
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (n - bad + 1.0))
    kept = (_counts(docs, lambda: _entries).where(F.col("bad") >= MIN_DOCS)
            # most of its documents are toxic, four standard deviations more than by chance
            .where((F.col("bad") > 4 * F.col("clean"))
                   & (F.col("bad") - base * seen > 4 * F.sqrt(base * (1 - base) * seen)))
            .select("entry", odds.alias("weight"), "bad").collect())
    got = {r["entry"]: float(r["weight"]) for r in kept}
    strength = {r["entry"]: float(r["weight"]) * r["bad"] ** 0.5 for r in kept}

    strength = _apart(strength)
    if strength:
        # an entry stays if it is common, or the strongest one of a toxic document
        own = {r["entry"] for r in _counts(docs, lambda: _strongest(strength)).where("bad >= 1").select("entry").collect()}
        often = {r["entry"] for r in kept if r["bad"] >= COMMON}
        strength = {e: v for e, v in strength.items() if e in own or e in often}
    lex = Lexicon({e: got[e] for e in strength}, [])
    if lex.weights:
        rows_ = (_counts(docs, lambda: _phrases(lex))
                 .where((F.col("clean") >= 2) & (F.col("clean") >= F.col("bad")))
                 .collect())
        lex.exceptions = sorted(r["entry"] for r in rows_)
    lex.line = _line(docs, lex)
    return lex


def _with_figures(docs: DataFrame, lex: Lexicon) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lex.automaton()
        for batch in batches:
            xy = [lex.figures(auto, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in xy], pa.float64()), pa.array([b for _, b in xy], pa.float64())],
                names=["y", "a", "b"])

    return docs.select("y", "folded").mapInArrow(run, "y int, a double, b double")


def _line(docs: DataFrame, lex: Lexicon) -> tuple[float, float, float]:
    """Logistic regression of the label on the two figures (Newton, ridge);
    rows of equal figures are counted by Spark first."""
    t = _with_figures(docs, lex).toArrow()
    x = np.stack([t.column("a").to_numpy(), t.column("b").to_numpy(), np.ones(t.num_rows)], axis=1)
    y = t.column("y").to_numpy().astype(float)
    w = np.zeros(3)
    ridge = np.diag([1e-2, 1e-2, 1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return tuple(float(v) for v in w)


def score(df: DataFrame, lex: Lexicon | None, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score (double, 0 to 1) of ``text``."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        auto = lex.automaton() if lex is not None else None
        for batch, texts in text_slices(batches, text):
            if lex is None:
                s = np.zeros(len(texts))
            else:
                x = np.array([lex.figures(auto, fold(t.decode("utf-8", "replace"))) for t in texts])
                a, b, c = lex.line
                s = 1 / (1 + np.exp(-np.clip(x[:, 0] * a + x[:, 1] * b + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())],
                                             names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)
