"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, fingerprint, lexical_search, licenses, lsh_forest, mixing, pii, quality, simhash_index,
               suffix_dedup, toxicity, whitening)
from .common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def fold(modulus: int, held: int):
    """True for the rows that no model learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held


@query
def op1_pii(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    base = pii.counts(F.col("base_spans"))
    return found.select("doc_id", *[base[k].alias(f"n_{k}") for k in pii.BASE],
                        F.sha2(pii.as_text(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.as_text(F.col("spans")).alias("spans"))


@query
def op2_chat_format(spark, sf_dir):
    calls, results = chat.derive(read(spark, sf_dir, "conversations"))
    return chat.link(calls, results, chat.TOOLS).select(
        "conv_id", "depth", "turn", "call_id", "name", "valid", F.array_join("errors", ",").alias("errors"),
        "n_results", "json")


def token_digests(docs: DataFrame) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    coded = bpe.encode_decode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_bpe(spark, sf_dir):
    return token_digests(read(spark, sf_dir, "documents"))


@query
def op4_simhash_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_index.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_fingerprint(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    d = (fingerprint.with_next(docs)
         .withColumn("edited", fingerprint.edited(F.col("text"), F.col("next_text"))))
    d = fingerprint.with_fingerprints(d, {"text": "fp", "edited": "fp_edited", "next_text": "fp_next"})
    return d.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("fp")).alias("fingerprint"),
        fingerprint.as_text(F.col("fp_edited")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("fp"), F.col("fp_edited")).alias("near_edited"),
        fingerprint.likeness(F.col("fp"), F.col("fp_next")).alias("near_next"))


@query
def op6_lsh_forest(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return lsh_forest.search(rows, rows.where("vec_id % 100 = 0"))


@query
def op7_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).select(
        "doc_id", fold(4, 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op8_suffix_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op10_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "copy")


@query
def op11_whitening(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(rows).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_license_scan(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"])))
    return licenses.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), licenses.score().alias("score"))


@query
def op13_lexical_search(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE: dict[str, str] = {"op2_chat_format": chat.SQL, "op8_suffix_dedup": suffix_dedup.SQL,
                          "op12_license_scan": licenses.sql(), "op13_lexical_search": lexical_search.SQL}
