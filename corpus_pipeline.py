"""A corpus from raw documents to tokens: filter, drop copies and near copies, drop benchmark leaks, encode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exselect.llm.bpe import digests, encode
from exselect.llm.decontaminate import flagged
from exselect.llm.exact_dedup import drop_copies
from exselect.llm.near_dedup import drop_near_copies
from exselect.llm.quality import classify
from exselect.llm.tables import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, similarity 0.8."""
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = flagged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), null_ids=True)
    return found.where(F.size("benchmark_items") == 0).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count of each document that is left, with digests of its ids and of what they decode to."""
    return digests(encode(docs.select("doc_id", "text")))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]

#: The fitted classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
