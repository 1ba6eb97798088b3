"""Expressions and automata against plain Python: the trees of op1, the matcher of op7."""

import random

import numpy as np
from pyspark.sql import functions as F

from logweave.llm import pii, toxicity


def test_trees_as_expressions_select_what_python_selects(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    assert model is not None and model.thresholds
    rows = pii.candidates(docs.withColumn("_t", F.coalesce("text", F.lit(""))), "_t")
    f = pii.features(F.col("c"))
    flat = rows.select("doc_id", F.explode("_more").alias("c")).select(
        "doc_id", "c.kind", "c.start", "c.end", *[f[n].alias(n) for n in pii.FEATURES]).collect()
    x = np.array([[r[n] for n in pii.FEATURES] for r in flat])
    p = 1 / (1 + np.exp(-(model.start + sum(pii._predict(t, x) for t in model.trees))))
    base = {r["doc_id"]: [(b["start"], b["end"]) for b in r["_base"]] for r in rows.select("doc_id", "_base").collect()}
    want = sorted((r["doc_id"], r["kind"], r["start"], r["end"]) for r, q in zip(flat, p)
                  if q >= model.thresholds.get(r["kind"], 2)
                  and not any(r["start"] < e and s < r["end"] for s, e in base[r["doc_id"]]))
    got = pii.find(docs, model).select("doc_id", F.explode("spans").alias("s")).collect()
    assert sorted((r["doc_id"], *r["s"]) for r in got if r["s"]["kind"] in pii.EXTRA) == want and want


def test_thresholds_come_from_the_other_half():
    """Rows the trees fit perfectly set no threshold when the other half contradicts them."""
    x = np.tile(np.arange(len(pii.FEATURES)), (4, 1))
    x[:, 0] = [0, 5, 0, 5]
    y = np.array([0.0, 1.0, 1.0, 0.0])
    fit = np.array([True, True, False, False])
    kinds = ["secret"] * 4
    assert pii.boost(x, y, np.full(4, 50.0), kinds, fit).thresholds == {}
    assert "secret" in pii.boost(x, np.array([0.0, 1.0, 0.0, 1.0]), np.full(4, 50.0), kinds, fit).thresholds


def test_matcher_equals_naive_search():
    rng = random.Random(6)
    for _ in range(200):
        entries = {" " + "".join(rng.choices("ab", k=rng.randint(1, 4))) + rng.choice(["", " "]): float(rng.randint(1, 9))
                   for _ in range(rng.randint(0, 6))}
        phrases = [" " + "".join(rng.choices("ab", k=2)) + " " + "".join(rng.choices("ab", k=2)) + " " for _ in range(2)]
        lex = toxicity.Lexicon(entries, phrases)
        text = toxicity.fold(" ".join("".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12))))
        hits = {}
        for e, w in sorted(entries.items()):
            for i in range(len(text)):
                if text.startswith(e, i):
                    inside = any(text.startswith(p, j) and j <= i and i + len(e) <= j + len(p)
                                 for p in phrases if p not in entries for j in range(len(text)))
                    if not inside:  # of entries at one place the longest counts
                        hits[i] = max(hits.get(i, (0, 0.0)), (len(e), w))
        total = sum(w for _, w in hits.values())
        n = max(1, text.count(" ") - 1)
        assert lex.figures(lex.automaton(), text) == (float(np.log1p(total)), float(np.log1p(100 * total / n)))


def test_one_text_of_a_frequent_id_is_learnt(spark):
    """An id with very many different texts takes one training row."""
    rows = [(1, f"plain words number {i}") for i in range(300)] + [(2 + i, f"vile gronk {i}" if i % 2 else f"calm prose {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i > 1 and i % 2 == 1)) for i in range(1, 62)], "doc_id long, toxic int")
    seen = []
    whole = toxicity._line
    toxicity._line = lambda d, lex: seen.append(d.count()) or whole(d, lex)
    try:
        toxicity.learn(docs, labels)
    finally:
        toxicity._line = whole
    assert seen and seen[0] <= 61
