"""The training-data pipeline over ``documents``: five stages, each a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import catalog, mixing, pii, quality, simhash_index
from logweave.llm.common import join_on, read
from logweave.session import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="_score").where("_score >= 0.5").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: the smallest id (a NULL id last),
    of several rows of it the first by text, then by the other columns."""
    key = ["doc_id", "_text", "_rest"]
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in docs.columns])
    d = docs.withColumns({"_text": F.xxhash64("text"), "_rest": F.xxhash64(*docs.columns, nulls)})
    near = simhash_index.near_duplicates(d.select(*key, "text"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), *key)).alias("_key")
    stay = near.groupBy("_root").agg(first).select("_root", *[f"_key.{c}" for c in key])
    # rows equal in all columns share a key; one of them stays
    return join_on(d, stay, key).dropDuplicates(["_root"]).select(*docs.columns)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.find(docs, pii.train(docs))
    text = pii.redact(F.col("text"), F.col("spans"))
    changed = F.size("spans") > 0
    out = found.withColumn("_text", F.when(changed, text).otherwise(F.col("text")))
    return out.select(*[
        F.col("_text").alias(c) if c == "text"
        else F.when(changed, F.length("_text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their temperature weights; rows repeat by the mix."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, encoded and decoded, as digests."""
    return catalog.token_digests(docs)


STAGES = [("quality", keep_good), ("near_dedup", one_of_each), ("pii", without_pii), ("mixing", mixed),
          ("tokens", tokens)]
#: SQL cannot express the trained stages; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
