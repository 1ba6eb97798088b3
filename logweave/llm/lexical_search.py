"""Ranked lexical search with pair-bound MaxScore.

``build_index`` turns the documents, task by task and without a shuffle, into shards of
about ``SHARD_BYTES`` of text: an inverted list (document, occurrences) for every term.
Counts over all documents (documents, terms, documents a term) come from the shards.
An array of a shard is stored packed, as one compressed binary value, so that Spark's side of a task
passes on a few MB a shard and holds no array of it; Python unpacks one shard at a time.

``prepare`` adds what a set of queries needs, a shard at a time: the lists of their
terms with the impacts (what a term adds to a document's score), the greatest impact a term,
and for every two terms that follow each other in a query their intersection list, sorted
by joint impact, whose first entry is the joint maximum.

A search bounds what a shard's documents can score.  Terms that follow each
other in a query form a path; the matching of the path that lowers the sum of maxima most
(joint maximum, or the greater of the two where a document holds only one, in place of the sum of
both) gives units of one or two terms.  If all units together stay under the threshold the
shard is skipped.  Else the units of least bound that together stay under it are
optional: only documents in the lists of the other units are looked at, and
the optional units are added from the greatest bound down, to documents that can still reach
the threshold.  The threshold is a score that ``k`` documents are known to reach: first from the
exact scores of the documents at the heads of the pair lists, then from the best found so far.
Nothing is cut that could be among the ``k`` best; scores are exact.

What leaves a task is ``k`` rows an item, however many documents it saw; the driver holds
one part of the queries (about ``PART_TERMS`` terms; more queries are more parts, each a pass
over the index).

Defined cases: NULL and empty texts have no terms and count nowhere; documents are rows: repeated
rows and ids are ranked one by one, a NULL doc_id comes last among equal scores; benchmark rows of one
item_id are one item, which has the terms of all its different texts; an item without terms or
matches has no rows; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, text_slices

K = 20
SHARD_BYTES = 8 << 20
PART_TERMS = 1 << 17
#: Bytes of texts that Spark hands to Python at once.
BATCH_BYTES = 4 << 20
#: Shards of a file, and so at most of a row group, which Spark's reader decodes as a whole.
FILE_SHARDS = 4
#: Documents at the head of a pair list, and scored documents of a task, from which thresholds start.
HEAD, SEEDS = 4, 5
#: The contract's class without A-Z: texts are lower-cased, as UTF-8, before the match.
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

INDEX = ("doc_ids array<long>, lengths array<long>, terms array<binary>, starts array<int>, docs array<int>, "
         "tfs array<int>, n_docs long, n_terms long")
PREPARED = ("doc_ids array<long>, terms array<int>, starts array<int>, docs array<int>, impacts array<long>, "
            "highest array<long>, pairs array<int>, pair_starts array<int>, pair_docs array<int>, joint array<long>")


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text; ``bytes.lower`` changes A-Z only."""
    return TERM.findall(text.lower())


# ---- index -------------------------------------------------------------------

class Shard:
    """Inverted lists of the documents added so far."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.lengths, self.sizes, self.tids, self.tfs, self.bytes = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = terms_of(text)
        if not found:
            return
        tf = Counter(found)
        number = self.number
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.sizes.append(len(tf))
        self.tids += [number[t] for t in tf]
        self.tfs += tf.values()
        self.bytes += len(text)

    def row(self) -> list:
        names = list(self.number)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), dtype=np.int64)
        rank[by_name] = np.arange(len(names))
        tids = rank[np.array(self.tids, dtype=np.int64)]
        docs = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.argsort(tids, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(tids, minlength=len(names)))])
        return [self.ids, self.lengths, [names[i] for i in by_name], starts.astype(np.int32), docs[order],
                np.array(self.tfs, dtype=np.int32)[order], len(self.ids), sum(self.lengths)]


def packed(values, kind: pa.DataType) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(values, kind)], ["v"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: pa.BinaryScalar) -> pa.Array:
    return pa.ipc.open_stream(value.as_buffer()).read_next_batch().column(0)


def record(row: list, schema: str) -> pa.RecordBatch:
    """A shard as a row of ``stored(schema)``."""
    kind = {"array<long>": pa.int64(), "array<int>": pa.int32(), "array<binary>": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([packed(v, kind[t])], pa.binary()) if t in kind else pa.array([v], pa.int64())
                                       for v, (_, t) in zip(row, fields)], [n for n, _ in fields])


def stored(schema: str) -> str:
    """The schema of a shard table: arrays are packed."""
    return re.sub(r"array<\w+>", "binary", schema)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts reach Python by ``BATCH_BYTES`` in what runs meanwhile; the caller's setting comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def build_index(docs: DataFrame) -> DataFrame:
    """The shards of ``docs`` (doc_id, text), as a table."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for part, texts in text_slices(batches, "text"):
            ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, text in zip(ids, texts):
                shard.add(doc_id, text)
            if shard.bytes >= SHARD_BYTES:
                yield record(shard.row(), INDEX)
                shard = Shard()
        if shard.ids:
            yield record(shard.row(), INDEX)

    with small_batches(docs.sparkSession):
        return materialize(docs.select("doc_id", "text").mapInArrow(build, stored(INDEX)), maxRecordsPerFile=FILE_SHARDS)


def shard_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """Rows of shard tables, a column of a row as an Arrow array."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: unpacked(batch.column(k)[i]) for k, n in enumerate(batch.schema.names)}


def numbers(row: dict[str, pa.Array], *names: str) -> list[np.ndarray]:
    return [row[n].to_numpy(zero_copy_only=False) for n in names]


def document_counts(index: DataFrame, vocabulary: list[bytes]) -> list[int]:
    """In how many documents each term occurs; partial counts a task."""
    def partial(batches):
        df: Counter[bytes] = Counter()
        for row in shard_arrays(batches):
            sizes = np.diff(row["starts"].to_numpy())
            for t, n in zip(row["terms"].to_pylist(), sizes.tolist()):
                if t in wanted:
                    df[t] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())],
                                         ["term", "df"])

    wanted = frozenset(vocabulary)
    rows = index.select("terms", "starts").mapInArrow(partial, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    df = {bytes(r["term"]): r["df"] for r in rows.collect()}
    return [df.get(t, 0) for t in vocabulary]


# ---- queries -----------------------------------------------------------------

class Queries:
    """Part of the queries: ``items`` as lists of (term, repeats) in order of first
    occurrence, ``pairs`` the neighbours in these lists, ``weights`` by term."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        number: dict[bytes, int] = {}
        self.items = [[(number.setdefault(t, len(number)), q) for t, q in Counter(ts).items()] for _, ts in rows]
        self.vocabulary = list(number)
        self.weights: list[int] = []
        pair_number: dict[tuple[int, int, int, int], int] = {}
        self.paths = [[pair_number.setdefault((*a, *b), len(pair_number)) for a, b in zip(item, item[1:])]
                      for item in self.items]
        self.pairs = list(pair_number)

    def weigh(self, n: int, df: list[int]) -> None:
        self.weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df]


def query_parts(items: DataFrame) -> Iterator[Queries]:
    """The items (item_id, text) by parts of about ``PART_TERMS`` terms, an item whole."""
    def split(batches):
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("item_id")),
                                              pa.array([terms_of(t) for t in texts], pa.list_(pa.binary()))], ["item_id", "terms"])

    different = items.select("item_id", "text").distinct()
    rows = materialize(different.mapInArrow(split, "item_id long, terms array<binary>").where(F.size("terms") > 0))
    total = rows.agg(F.sum(F.size("terms"))).first()[0] or 0
    parts = -(-total // PART_TERMS)
    for p in range(parts):
        mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == p)
        whole = mine.groupBy("item_id").agg(F.flatten(F.array_sort(F.collect_list("terms"))).alias("terms"))
        got = [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in whole.orderBy("item_id").collect()]
        if got:
            yield Queries(got)


# ---- impacts and pair lists --------------------------------------------------

def prepare(index: DataFrame, q: Queries, n: int, total: int) -> DataFrame:
    """Impact lists and pair intersection lists of the queries' terms, a row a shard."""
    number = {t: i for i, t in enumerate(q.vocabulary)}
    weights, pairs = q.weights, q.pairs
    by_first: dict[int, list[int]] = defaultdict(list)
    for p, (a, *_) in enumerate(pairs):
        by_first[a].append(p)

    def build(batches):
        for row in shard_arrays(batches):
            lengths, starts, docs, tfs = numbers(row, "lengths", "starts", "docs", "tfs")
            m = 12 * (75 + (25 * lengths * n) // total)
            here, lists = [], {}
            for k, t in enumerate(row["terms"].to_pylist()):
                i = number.get(t)
                if i is not None and weights[i]:
                    d, tf = docs[starts[k]:starts[k + 1]], tfs[starts[k]:starts[k + 1]].astype(np.int64)
                    lists[i] = d, weights[i] * ((1000000000 * tf) // (1000 * tf + m[d]))
            here = sorted(lists)
            found, pair_docs, joint = [], [], []
            place = np.full(len(lengths), -1)
            for a in here:
                mine = [p for p in by_first.get(a, ()) if pairs[p][2] in lists]
                if not mine:
                    continue
                da, ia = lists[a]
                place[da] = np.arange(len(da))
                for p in mine:
                    _, qa, b, qb = pairs[p]
                    db, ib = lists[b]
                    at = place[db]
                    both = at >= 0
                    if both.any():
                        sums = qa * ia[at[both]] + qb * ib[both]
                        order = np.argsort(-sums, kind="stable")
                        found.append(p)
                        pair_docs.append(db[both][order])
                        joint.append(int(sums[order[0]]))
                place[da] = -1
            def ends(xs):
                return np.cumsum([0, *[len(x) for x in xs]]).astype(np.int32)
            flat = [lists[i] for i in here]
            none = np.empty(0, dtype=np.int64)
            yield record([row["doc_ids"], here, ends([d for d, _ in flat]), np.concatenate([none, *[d for d, _ in flat]]).astype(np.int32),
                          np.concatenate([none, *[i for _, i in flat]]), [int(i.max()) for _, i in flat], found, ends(pair_docs),
                          np.concatenate([none, *pair_docs]).astype(np.int32), joint], PREPARED)

    lists = index.select("doc_ids", "lengths", "terms", "starts", "docs", "tfs").mapInArrow(build, stored(PREPARED))
    return materialize(lists, maxRecordsPerFile=FILE_SHARDS)


class Lists:
    """One prepared shard."""

    def __init__(self, row: dict[str, pa.Array]):
        terms, starts, docs, impacts, highest, pairs, pair_starts, pair_docs, joint = numbers(
            row, *[f.split()[0] for f in PREPARED.split(", ")][1:])
        self.ids, self.size = row["doc_ids"], len(row["doc_ids"])
        s, ps = starts.tolist(), pair_starts.tolist()
        self.postings = {t: (docs[s[k]:s[k + 1]], impacts[s[k]:s[k + 1]]) for k, t in enumerate(terms.tolist())}
        self.highest = dict(zip(terms.tolist(), highest.tolist()))
        self.joint = dict(zip(pairs.tolist(), joint.tolist()))
        self.heads = {p: pair_docs[ps[k]:min(ps[k] + HEAD, ps[k + 1])] for k, p in enumerate(pairs.tolist())}

    def add(self, scores: np.ndarray, at: np.ndarray, term: int, repeats: int) -> None:
        """Adds a term's impacts to the documents ``at`` (sorted)."""
        docs, impacts = self.postings[term]
        k = np.minimum(np.searchsorted(docs, at), len(docs) - 1)
        scores += np.where(docs[k] == at, repeats * impacts[k], 0)

    def seeds(self, item: list[tuple[int, int]], path: list[int]) -> np.ndarray:
        """Exact scores of the documents most often at the head of the item's pair lists."""
        heads = [self.heads[p] for p in path if p in self.heads]
        terms = [(t, r) for t, r in item if t in self.postings]
        if not heads:
            heads = [self.postings[t][0][:HEAD] for t, _ in terms]
        if not heads:
            return np.empty(0, dtype=np.int64)
        docs, votes = np.unique(np.concatenate(heads), return_counts=True)
        at = np.sort(docs[np.argsort(-votes, kind="stable")[:SEEDS]])
        scores = np.zeros(len(at), dtype=np.int64)
        for t, r in terms:
            self.add(scores, at, t, r)
        return scores

    def units(self, item: list[tuple[int, int]], path: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
        """(bound, terms) of the matching of the item's path with the least sum of bounds."""
        ub = [r * self.highest.get(t, 0) for t, r in item]
        bound = [max(self.joint.get(p, 0), ub[k], ub[k + 1]) for k, p in enumerate(path)]
        # best[k]: the least sum of bounds of the first k terms
        best, paired = [0, ub[0]], [False, False]
        for k in range(1, len(ub)):
            alone, together = best[k] + ub[k], best[k - 1] + bound[k - 1]
            paired.append(together < alone)
            best.append(min(alone, together))
        out, k = [], len(ub)
        while k:
            step = 2 if paired[k] else 1
            out.append((bound[k - 2] if step == 2 else ub[k - 1], item[k - step:k]))
            k -= step
        return [u for u in out if u[0]]

    def search(self, item: list[tuple[int, int]], path: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that score ``least`` or more, and more than 0, with their scores; empty arrays where the bounds rule all out."""
        units = sorted(self.units(item, path), key=lambda u: u[0])
        rest = 0
        for optional, (bound, _) in enumerate(units):
            if rest + bound >= least:
                break
            rest += bound
        else:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        total = np.zeros(self.size, dtype=np.int64)
        for _, terms in units[optional:]:
            for t, r in terms:
                if t in self.postings:
                    docs, impacts = self.postings[t]
                    total[docs] += r * impacts
        at = np.flatnonzero(total)
        scores = total[at]
        for bound, terms in reversed(units[:optional]):
            keep = scores + rest >= least
            at, scores = at[keep], scores[keep]
            if not len(at):
                break
            for t, r in terms:
                if t in self.postings:
                    self.add(scores, at, t, r)
            rest -= bound
        keep = scores >= max(least, 1)
        return at[keep], scores[keep]


class Best:
    """The ``k`` best rows of an item so far."""

    def __init__(self, least: int, k: int):
        self.k, self.least = k, least
        self.rows: list[tuple[int, bool, int]] = []

    def add(self, ids: pa.Array, at: np.ndarray, scores: np.ndarray) -> None:
        if not len(at):
            return
        if len(at) > self.k:  # ties of the k-th score stay, the ids decide
            keep = scores >= np.partition(scores, -self.k)[-self.k]
            at, scores = at[keep], scores[keep]
        new = [(-s, i is None, i or 0) for s, i in zip(scores.tolist(), ids.take(pa.array(at)).to_pylist())]
        self.rows = sorted(self.rows + new)[:self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def first_thresholds(prepared: DataFrame, q: Queries, k: int) -> list[int]:
    """For each item a score that ``k`` documents reach (0: unknown)."""
    items, paths = q.items, q.paths

    def scored(batches):
        best = [np.empty(0, dtype=np.int64) for _ in items]
        for row in shard_arrays(batches):
            lists = Lists(row)
            for i, (item, path) in enumerate(zip(items, paths)):
                both = np.concatenate([best[i], lists.seeds(item, path)])
                best[i] = -np.sort(-both)[:SEEDS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(items)), [len(b) for b in best])), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *best]))],
            ["item", "score"])

    seeds = prepared.mapInArrow(scored, "item long, score long")
    ranked = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"))))
    known = {r["item"]: r["score"] for r in ranked.where(F.col("rank") <= k).where(F.col("rank") == k).collect()}
    return [known.get(i, 0) for i in range(len(items))]


def search_part(index: DataFrame, q: Queries, n: int, total: int, k: int) -> DataFrame:
    q.weigh(n, document_counts(index, q.vocabulary))
    prepared = prepare(index, q, n, total)
    least = first_thresholds(prepared, q, k)
    ids, items, paths = q.ids, q.items, q.paths

    def found(batches):
        best = [Best(x, k) for x in least]
        for row in shard_arrays(batches):
            lists = Lists(row)
            for b, item, path in zip(best, items, paths):
                b.add(lists.ids, *lists.search(item, path, b.least))
        rows = [(ids[i], None if none else doc, -s) for i, b in enumerate(best) for s, none, doc in b.rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
                                         ["item_id", "doc_id", "score"])

    return prepared.mapInArrow(found, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text)
    for each of ``items`` (item_id, text)."""
    index = build_index(docs)
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    # not createDataFrame, whose rows would start Python processes of their own
    none = [f"CAST(NULL AS {t}) AS {c}" for c, t in (("item_id", "long"), ("rank", "int"), ("doc_id", "long"), ("score", "long"))]
    out = index.sparkSession.range(0).selectExpr(*none)
    if not size["n"]:
        return out
    for q in query_parts(items):
        out = out.unionByName(search_part(index, q, size["n"], size["total"], k).withColumn("rank", F.lit(0)))
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


#: DuckDB SQL of the ranking: every document against every item, by their common terms.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i) GROUP BY item_id, t),
c AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, c GROUP BY t, n),
m AS (SELECT r, doc_id, (75 + (25 * len(ts)::BIGINT * n) // l)::BIGINT AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST)::INT AS rank
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""
