"""A corpus pipeline: five stages, each by one operator of the ``llm`` subpackage.

Every stage takes the rows its predecessor kept and returns rows of ``documents``; the last one adds
the ids of the pieces. Null texts fail the quality rules; rows without an id pass the stages that
compare ids. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptlake.llm import mixing, quality_repeats, secrets, sentencepiece_fst, simhash_index
from promptlake.llm.queries import load, piece_model
from promptlake.session import new_run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the limits on repetition."""
    return quality_repeats.repetition(docs).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return simhash_index.keep_one(docs).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets blotted out."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the tempered weights of their sources ask."""
    return mixing.take(docs).select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, whose decoding was compared with the text."""
    return sentencepiece_fst.encode_checked(docs, piece_model()).select(*COLUMNS, "n_tokens", "round_trip", "ids")


STAGES = [
    ("quality rules", quality), ("near duplicates", near_duplicates), ("secret scan", secret_scan),
    ("source mixing", mix_sources), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_run_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
