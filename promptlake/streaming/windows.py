"""Windowed streaming operators on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.rules import LATENCY_BUCKETS


def stream_metrics(events: DataFrame, delay: str = "1 minute", span: str = "5 minutes", step: str = "15 seconds",
                   bounds=LATENCY_BUCKETS) -> DataFrame:
    """Hits, calls, hit ratio, cost, savings and latency buckets of the last five minutes.

    Events are first summed per step; the sliding window then runs over those sums, so an
    event enters one state row and not one per window.
    """
    hit, call = F.col("tier").isin("l1_hash", "l2_semantic"), F.col("tier") == "llm"
    seconds = F.col("latency_ms") / 1000.0
    names = [f"le_{i}" for i in range(len(bounds))]
    sums = ["hits", "calls", "cost_units", "saved_units", *names]
    per_step = events.withWatermark("ts", delay).groupBy(F.window("ts", step)).agg(
        F.count_if(hit).alias("hits"), F.count_if(call).alias("calls"),
        F.sum(F.when(call, F.col("cost_units")).otherwise(0)).alias("cost_units"),
        F.sum(F.when(hit, F.col("saved_units")).otherwise(0)).alias("saved_units"),
        *[F.count_if((hit | call) & (seconds <= F.lit(float(b)))).alias(n) for n, b in zip(names, bounds)])
    slid = per_step.groupBy(F.window(F.window_time("window"), span, step)).agg(
        *[F.sum(c).alias(c) for c in sums])
    return slid.select(
        F.col("window.end").alias("ts"), *sums,
        F.try_divide(F.col("hits"), F.col("hits") + F.col("calls")).alias("hit_ratio"))


def stream_dedup(requests: DataFrame, horizon: str = "1 hour", key: str = "cache_key") -> DataFrame:
    """First request of each key inside the horizon; later copies are dropped."""
    return requests.withWatermark("ts", horizon).dropDuplicatesWithinWatermark([key])
