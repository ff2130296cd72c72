"""The corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, BPE.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Extra columns
pass through; rows with null texts or ids are judged as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomaudit.llm import bpe, decontamination, near_copies, quality_rules, toxicity
from loomaudit.llm.common import fresh, load, new_path

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what neither a base rule nor the learned decision list rejects."""
    rules = quality_rules.fit(docs, load(spark, sf_dir, "labels"))
    statistics, failed, kept = (fresh(docs, c) for c in ("quality_statistics", "quality_failed", "quality_kept"))
    return quality_rules.judged(docs, rules, statistics, failed, kept).where(F.col(kept)).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what scores below the toxicity threshold; the lexicon is learned on what the stage before has kept."""
    lexicon = toxicity.learn_lexicon(docs, load(spark, sf_dir, "labels"))
    score = fresh(docs, "toxicity")
    return docs.withColumn(score, toxicity.score(lexicon, F.col("text"))).where(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts with a five-word similarity of 0.8 or more."""
    return near_copies.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that a benchmark item has leaked into."""
    return decontamination.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and whether decoding gives the text back."""
    made = bpe.with_ids(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), decoded="decoded")
    return made.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", distinct), ("decontamination", decontaminated), ("bpe", encoded)]

#: Learned rules and BPE merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents of sf_dir."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
