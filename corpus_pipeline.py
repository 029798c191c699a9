"""A corpus pipeline: language filter, near duplicates, repeated passages, mixing and packing, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteval.llm import jaccard, langid, mixing, packing, passages
from siteval.llm.common import settled

#: mean probability that a text needs of its best language
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language the network cannot tell. Without any label nothing can be learned and all stay."""
    net = langid.train(docs)
    if net is None:
        return docs
    told = docs.withColumn("_p", langid.identify(F.col("text"), net))
    return told.filter((F.col("_p.lang_pred") != langid.UNDETERMINED) & (F.col("_p.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of every group of near duplicates."""
    return jaccard.deduplicated(docs)


def passages_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds; n_chars follows the text."""
    cut = passages.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents, rare ones more than once, so that the expected token shares meet the targets of source, language and topic."""
    return mixing.repeated(mixing.mixed(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the documents to length buckets and batches."""
    return packing.packed(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", passages_once), ("mixing to target weights", mixing_weights), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = settled(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
