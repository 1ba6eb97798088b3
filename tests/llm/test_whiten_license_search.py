"""Whitening, license scan and lexical search against brute-force versions."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_cases import SMALL

from logweave.llm import catalog, lexical_search, licenses, whitening


def run_query(name, monkeypatch, spark, **tables):
    monkeypatch.setattr(catalog, "read", lambda _s, _d, table: tables[table])
    return catalog.QUERIES[name](spark, "unused").collect()


def frame(spark, which, edge, docs, nothing):
    return {"edge": edge, "docs": docs, "nothing": nothing}[which]


CASES = pytest.mark.parametrize("which", ["edge", "docs", "nothing"])


# ---- 11 whitening ------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, n long, x string, whitened int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VEC).repartition(3)


def check_whitening(rows, got):
    """All statements of the contract, from exact fractions and numpy's own covariance."""
    dims = Counter(len(v) for _, v in rows if v).most_common()
    size = max(d for d, c in dims if c == dims[0][1]) if dims else 0
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and len(v) == size]
    fit = sorted({tuple(v) for _, v in x})
    n, k = len(fit), min(4, size)
    s = [sum(v[d] for v in fit) for d in range(size)]
    cov = np.array([[float(sum(Fraction(n * v[a] - s[a]) * (n * v[b] - s[b]) for v in fit) / n ** 3)
                     for b in range(size)] for a in range(size)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    assert len(got) == len(x) * k
    want = Counter()
    for i, v in x:
        dev = sum((n * a - b) ** 2 for a, b in zip(v, s))
        for c in range(k):
            want[i, c + 1, n, dev if dev < 1 << 63 else None] += 1
    assert Counter((r["vec_id"], r["component"], r["n"], r["deviation"]) for r in got) == want
    sign = {}
    index = {}
    for i, v in x:
        index.setdefault(i, []).append([float((np.array(v) - np.array(s) / n) @ u[:, c] / math.sqrt(e[c])) for c in range(k)])
    for r in got:
        c = r["component"] - 1
        assert r["explained"] == pytest.approx(e[c] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-9
        near = min(index[r["vec_id"]], key=lambda w: min(abs(w[c] - r["whitened"]), abs(w[c] + r["whitened"])))[c]
        assert abs(near) == pytest.approx(abs(r["whitened"]), abs=1e-6)
        if abs(near) > 1e-3 and len(index[r["vec_id"]]) == 1:
            assert sign.setdefault(c, np.sign(near * r["whitened"])) == np.sign(near * r["whitened"])


def test_whitening_edge_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in rng.normal(size=5) * [4, 3, 2, 1, .5]]) for i in range(60)]
    good += [(7, good[7][1]), (61, good[3][1]), (None, good[4][1]), (62, [0.0, -0.0, 0.0, 0.0, 0.0]), (7, good[9][1])]
    bad = [(70, None), (71, []), (72, [1.0, None, 1.0, 1.0, 1.0]), (73, [1.0, float("nan"), 1.0, 1.0, 1.0]),
           (74, [1.0, float("inf"), 1.0, 1.0, 1.0]), (75, [1.0, 2.0])]
    got = run_query("op11_whitening", monkeypatch, spark, embeddings=vectors(spark, good + bad))
    check_whitening(good, got)


def test_whitening_of_given_table(spark):
    rows = [(r["vec_id"], r["embedding"][:6]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())


def test_whitening_without_spread(spark, monkeypatch):
    """An empty table, one vector, and a dimension that never changes."""
    assert run_query("op11_whitening", monkeypatch, spark, embeddings=vectors(spark, [(1, None)])) == []
    one = run_query("op11_whitening", monkeypatch, spark, embeddings=vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    flat = [(i, [float(i), 7.0]) for i in range(10)]
    got = run_query("op11_whitening", monkeypatch, spark, embeddings=vectors(spark, flat))
    assert {r["whitened"] is None for r in got if r["component"] == 2} == {True}
    assert {round(r["explained"], 9) for r in got if r["component"] == 1} == {1.0}
    assert max(r["identity_error"] for r in got) < 1e-9


def test_exact_sums_of_wide_values():
    """Each of the three ways to add squares, and digits in and out."""
    rng = random.Random(3)
    for bits in (20, 40, 60):
        v = [[rng.randint(-(1 << bits) + 1, (1 << bits) - 1) for _ in range(3)] for _ in range(500)]
        a = np.array(v, dtype=np.int64)
        assert whitening.square_sums(a, 1 << bits).tolist() == [sum(r[c] ** 2 for r in v) for c in range(3)]
        assert whitening.column_sums(a).tolist() == [sum(r[c] for r in v) for c in range(3)]
        big = sum(r[0] ** 2 for r in v)
        assert sum(d << (32 * k) for k, d in enumerate(whitening.limbs(big))) == big


def test_deviation_beyond_long(spark, monkeypatch):
    rows = [(i, [float(i % 2) * 3e16, float(i)]) for i in range(12)]
    got = run_query("op11_whitening", monkeypatch, spark, embeddings=vectors(spark, rows))
    assert {r["deviation"] for r in got} == {None}
    assert max(r["identity_error"] for r in got if r["identity_error"] is not None) < 1e-6


# ---- 12 licenses -------------------------------------------------------------

LICENSE_ROWS = [
    (100, "Released under the MIT License."),
    (101, "mit license MIT-LICENSE; Apache   License and the\nGENERAL public License"),
    (102, "Licensed under CC BY-NC 4.0."), (103, "licensed UNDER cc by 4 0"),
    (104, "rights reserved, all of them"), (105, "mit\nlicence license mit"), (106, "mitlicense mit_license Émit license"),
    (107, " ".join(licenses.TEMPLATES[2][1].replace("free of charge", "gratis").split()) + " end"),
    (108, "word " * 3000 + licenses.TEMPLATES[7][1] + " word" * 3000),
    (109, "general public license " * 300), (None, "All rights reserved."), (100, "Released under the MIT License."),
]


def brute_license(text, threshold=licenses.THRESHOLD):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [(i, label) for p, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
            for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    met = []
    for label, t in licenses.TEMPLATES:
        tw = re.findall(r"[a-z0-9]+", t.lower())
        length = 1
        while length < len(tw):
            length *= 2
        for start in range(0, len(ws), length):
            share = len(set(tw) & set(ws[start:start + 2 * length])) / len(set(tw))
            if share >= threshold:
                met.append((label, share))
    starts = [i for i, _ in base]
    labels = {label for _, label in base} | {label for label, _ in met}
    return (len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({b for _, b in base})),
            ",".join(sorted(labels)), 1.0 if base else max((s for _, s in met), default=0.0))


@CASES
def test_licenses(spark, monkeypatch, which, edge, docs, nothing):
    df = frame(spark, which, edge, docs, nothing)
    if which == "edge":
        df = df.select("doc_id", "text").union(spark.createDataFrame(LICENSE_ROWS, "doc_id long, text string")).withColumn("label", df["text"])
    got = run_query("op12_license_scan", monkeypatch, spark, documents=df)
    want = Counter((r["doc_id"], *brute_license(r["text"])) for r in df.collect())
    assert Counter(tuple(r) for r in got) == want
    if which == "edge":
        by_id = {r["doc_id"]: r["labels"] for r in got}
        assert by_id[102] == "cc,cc-nc" and by_id[103] == "cc" and by_id[104] == "proprietary"
        assert by_id[107] == "mit" and by_id[108] == "gpl"


def test_join_loses_no_pair():
    """Prefix, length and positional filters against all pairs, at several thresholds."""
    rng = random.Random(11)
    names = [b"w%d" % i for i in range(30)]
    for threshold in (0.5, 0.75, 0.9, 1.0):
        templates = [("t", b" ".join(rng.choices(names, k=rng.randint(1, 12))).decode()) for _ in range(60)]
        classes = licenses.prepare(templates, threshold)
        order = names[:]
        rng.shuffle(order)
        rank = {w: i for i, w in enumerate(order)}
        for ts in classes.values():
            join = licenses.Join(ts, rank)
            for _ in range(150):
                block = set(rng.sample(names, rng.randint(1, 20)))
                want = {(id(t), len(t.words & block)) for t in ts if len(t.words & block) / t.size >= threshold}
                assert {(id(t), n) for t, n in join.matches(block)} == want


def test_templates_are_bounded(spark, nothing):
    with pytest.raises(ValueError):
        licenses.scan(nothing, [("x", "a b")] * (licenses.MAX_TEMPLATES + 1))
    with pytest.raises(ValueError):
        licenses.scan(nothing, [("x", "...")])


# ---- 13 lexical search -------------------------------------------------------

def brute_search(docs, items, k=20):
    def terms(t):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)

    rows = [(i, Counter(ts), len(ts)) for i, ts in ((i, terms(t)) for i, t in docs) if ts]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    asked = {}
    for i, t in set(items):
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c, size in rows:
            m = 100 - 25 + ((25 * size * n) // total)
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, r in q.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k])]
    return out


def key(r):
    return repr(tuple(r))


ITEMS = [(1, "The QUICK brown fox and leaves"), (2, None), (3, ""), (4, "... !"), (5, "zzz unknown"),
         (6, "a second line line line 中文 Ünïcödé"), (6, "a second line line line 中文 Ünïcödé"), (6, "potion"), (None, "the the queen")]


@CASES
def test_search(spark, monkeypatch, which, edge, docs, nothing):
    df = frame(spark, which, edge, docs, nothing)
    items = spark.createDataFrame([(i, t, 1, "r") for i, t in ITEMS], "item_id long, text string, score int, rank string")
    if which == "docs":
        given = spark.read.parquet(f"{SMALL}/benchmark.parquet").selectExpr("item_id + 10", "text", "1", "'r'")
        items = items.union(given)
    got = run_query("op13_lexical_search", monkeypatch, spark, documents=df, benchmark=items)
    want = brute_search([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()],
                        [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(key, got)) == sorted(map(key, want))
    none = spark.createDataFrame([], "item_id long, text string")
    if which == "edge":
        assert run_query("op13_lexical_search", monkeypatch, spark, documents=df, benchmark=none) == []


def test_search_skips_and_stays_exact(spark, monkeypatch):
    """Many small shards and several query parts; pair bounds rule out whole shards that single maxima do not."""
    rng = random.Random(2)
    names = [f"t{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 60)))) for i in range(1500)]
    items = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 25)))) for i in range(25)]
    docs += [(2000 + i, items[i % 25][1] + " " + items[i % 25][1]) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 4000)
    monkeypatch.setattr(lexical_search, "PART_TERMS", 150)
    got = lexical_search.search(df, asked).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute_search(docs, items)))


def test_search_keeps_tasks_small(spark, monkeypatch):
    """Texts reach Python some MB at a time, arrays of a shard stay packed in Spark, and only the search starts Python."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(300))) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)

    def slices(batches, column, real=lexical_search.text_slices):
        for batch in batches:
            if batch.nbytes > 5 << 20:
                raise ValueError(f"{batch.nbytes} bytes at once")
            yield from real([batch], column)

    monkeypatch.setattr(lexical_search, "text_slices", slices)
    monkeypatch.setattr(lexical_search, "SHARD_BYTES", 1 << 20)
    monkeypatch.setattr(lexical_search, "FILE_SHARDS", 2)
    index = lexical_search.build_index(df)
    assert spark.conf.get(setting) == before
    assert not [f.name for f in index.schema if f.dataType.typeName() == "array"]
    files = [pq.ParquetFile(unquote(urlparse(f).path)).metadata.num_rows for f in index.inputFiles()]
    assert sum(files) >= 3 and max(files) <= 2
    postings = sum(len(set(t.split())) for _, t in docs)
    assert sum(len(r["docs"]) + len(r["tfs"]) for r in index.collect()) < 4 * postings  # plain: 8 a posting
    rows = [{n: lexical_search.unpacked(pa.scalar(bytes(r[n]))) for n in ("terms", "starts", "docs", "tfs", "doc_ids")} for r in index.collect()]
    got = Counter()
    for r in rows:
        starts, at, tfs, ids = (r[n].to_pylist() for n in ("starts", "docs", "tfs", "doc_ids"))
        for k, t in enumerate(r["terms"].to_pylist()):
            got.update({(ids[at[j]], t.decode()): tfs[j] for j in range(starts[k], starts[k + 1])})
    assert got == Counter((i, t) for i, text in docs for t in text.split())
    asked = spark.createDataFrame([(1, "w1 w2 w3 w4"), (2, "w7 nothing")], "item_id long, text string")
    found = lexical_search.search(df, asked)
    assert "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "int", "bigint", "bigint"]
    assert sorted(map(key, found.collect())) == sorted(map(key, brute_search(docs, [(r[0], r[1]) for r in asked.collect()])))


def test_pair_bounds_tighten():
    """Two rare terms that never meet: their pair is bounded by the greater one."""
    import pyarrow as pa
    q = lexical_search.Queries([(1, [b"a", b"b", b"c"])])
    q.weigh(100, [3, 3, 50])
    row = {"doc_ids": pa.array([1, 2, 3]), "terms": pa.array([0, 1, 2], pa.int32()), "starts": pa.array([0, 1, 2, 3], pa.int32()),
           "docs": pa.array([0, 1, 2], pa.int32()), "impacts": pa.array([900, 800, 10]), "highest": pa.array([900, 800, 10]),
           "pairs": pa.array([], pa.int32()), "pair_starts": pa.array([0], pa.int32()), "pair_docs": pa.array([], pa.int32()),
           "joint": pa.array([], pa.int64())}
    lists = lexical_search.Lists(row)
    assert sum(b for b, _ in lists.units(q.items[0], q.paths[0])) == 910
    assert len(lists.search(q.items[0], q.paths[0], 950)[0]) == 0
    assert lists.search(q.items[0], q.paths[0], 850)[0].tolist() == [0]
