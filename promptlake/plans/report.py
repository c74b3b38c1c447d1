"""What the caches were worth: one table over an attributed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.functions.cost import to_usd


def cache_report(attributed: DataFrame) -> DataFrame:
    """Per tier: requests and their share, tokens sent, cost and saving. One aggregate."""
    call = F.col("tier") == "llm"
    per = attributed.groupBy("tier").agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum(F.when(call, F.col("tokens_in").cast("bigint"))), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum(F.when(call, F.col("tokens_out").cast("bigint"))), F.lit(0)).alias("tokens_out"),
        to_usd(F.sum("cost_units")).alias("cost_usd"), to_usd(F.sum("saved_units")).alias("saved_usd"))
    total = per.agg(F.sum("requests")).scalar()
    return per.withColumn("share_pct", F.bround(F.col("requests") * 100.0 / total, 1))
