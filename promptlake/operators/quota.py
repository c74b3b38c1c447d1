"""Monthly quota: usage totals and the gate in log order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.functions.quota import quota_month, quota_remaining, quota_status
from promptlake.operators.ordered import running_sum, time_bucket
from promptlake.session import cut


def quota_usage(calls: DataFrame, tokens: str = "tokens", ts: str = "ts") -> DataFrame:
    """Tokens per user and month. Pass answered calls only: hits cost nothing."""
    return calls.groupBy("user_id", quota_month(ts).alias("month")).agg(
        F.sum(F.col(tokens).cast("bigint")).alias("tokens"))


def quota_gate(misses: DataFrame, quota: int = 100_000, tokens: str = "tokens", ts: str = "ts",
               rid: str = "request_id", bucket_s: int = 300) -> DataFrame:
    """Adds month, ``used_before``, ``status``, ``remaining`` and ``admitted``.

    The check comes before the call and its tokens after, so the last admitted request may
    overshoot. Once usage reaches the quota nothing more is admitted, hence the prefix sum
    over all requests decides exactly as the one over admitted requests would.

    The input is read several times, so it is stored first: pass narrow rows.
    """
    d = running_sum(
        cut(misses).withColumn("month", quota_month(ts)), F.col(tokens).cast("bigint"),
        ["user_id", "month"], [ts, rid], time_bucket(ts, bucket_s), "_offered", inclusive=False)
    admitted = F.col("_offered") < quota
    # after the last admitted request the usage stays where that request left it
    over = (
        d.filter(admitted).groupBy("user_id", "month")
        .agg(F.max(F.col("_offered") + F.col(tokens)).alias("_final")))
    return (
        d.join(over, ["user_id", "month"], "left")
        .withColumn("admitted", admitted)
        .withColumn("used_before", F.when(admitted, F.col("_offered")).otherwise(F.col("_final")))
        .withColumn("status", quota_status("used_before", quota))
        .withColumn("remaining", quota_remaining("used_before", quota))
        .drop("_offered", "_final"))
