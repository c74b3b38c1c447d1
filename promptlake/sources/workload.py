"""Repeat workloads for cache benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def build_workload(questions: DataFrame, repeats: int = 2, seed: int = 42) -> DataFrame:
    """Every question once in order, then ``repeats - 1`` shuffled copies.

    Sorting by (``round``, ``order_key``) gives the run order. The copies are ordered by a
    seeded hash, so the shuffle needs no global numbering.
    """
    n = questions.agg(F.count(F.lit(1))).scalar()
    return (
        questions.withColumn("_n", n)
        .withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .select(
            F.when(F.col("round") == 0, F.col("idx")).otherwise(F.col("idx") + F.col("_n")).alias("idx"),
            "question",
            (F.col("round") > 0).alias("is_duplicate"),
            F.col("idx").alias("original_idx"),
            "round",
            F.when(F.col("round") == 0, F.col("idx").cast("bigint")).otherwise(
                F.xxhash64(F.lit(seed), F.col("round"), F.col("idx"))).alias("order_key")))
