"""Evaluation files: JSON arrays with explicit schemas, and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptlake import schemas


def _read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_eval_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _read_array(spark, path, schemas.EVAL_PAIR)


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    return _read_array(spark, path, schemas.WORKLOAD)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return _read_array(spark, path, schemas.BENCH_RESULT)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """Write a report table; every partition writes its own file."""
    df.write.format(fmt).mode(mode).save(path)
