"""Training-corpus pipeline over `documents`.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is
written as Parquet in the shared checkpoint folder and read again as the next
stage's docs, so a lost executor costs one stage at most.

    toxicity         documents scored as toxic go
    ngram_join       of each group of near copies (5-word shingles, Jaccard 0.8) one document stays
    decontaminate    documents that hold a benchmark item go
    pii              personal data is replaced by pseudonyms
    mixing           documents are sampled to the target mix; adds weight and probability

Empty inputs give empty results; see the operators for nulls and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.llm import common, decontaminate as leaks, mixing as mix, ngram_join as near, pii as private, toxicity as tox


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score reaches one half, by a model fitted on the labelled ones."""
    model = tox.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tox.below(docs, model, 0.5)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one of each group of near copies, the one of the smallest id."""
    return near.one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item."""
    return leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms for personal data; n_chars follows the text."""
    out = private.pseudonymize(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs sampled to the target mix, with their weight and probability."""
    return mix.sample(docs)


STAGES = [(f.__name__, f) for f in (toxicity, ngram_join, decontaminate, pii, mixing)]

#: no SQL: a trained model, keyed permutations and an iterative fit; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.scratch_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.release_shuffles(spark)
    return docs
