"""Queue depth on a fixed grid, its moving averages and scaling flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from promptlake.config import Config
from promptlake.operators.ordered import time_bucket, trailing_mean
from promptlake.session import width

_CONFIG = Config()


def queue_depth(calls: DataFrame, step_s: int = 5, pod: str = "pod", enter: str = "enter_ts",
                exit_: str = "exit_ts") -> DataFrame:
    """Depth per pod every ``step_s`` seconds: calls entered and not yet left.

    A mark of an exit at depth zero leaves the depth at zero, as a counter held at zero would:
    depth = sum so far - least(0, lowest sum so far). Marks are netted per microsecond (of the
    same microsecond, entries count first), then per grid step and hour as (sum, lowest sum), so
    the series grows with time and pods, not with calls.
    """
    step = step_s * 1_000_000
    marks = F.explode(F.array(
        F.struct(F.unix_micros(F.col(enter).cast("timestamp")).alias("us"), F.lit(1).alias("d")),
        F.struct(F.unix_micros(F.col(exit_).cast("timestamp")).alias("us"), F.lit(-1).alias("d"))))
    so_far = lambda *by: Window.partitionBy(pod, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    steps = (
        calls.select(pod, marks.alias("m")).filter(F.col("m.us").isNotNull())
        .groupBy(pod, F.col("m.us").alias("us")).agg(F.sum("m.d").alias("d"))
        .withColumn("g", F.ceil(F.col("us") / F.lit(step)).cast("bigint"))
        .withColumn("low", F.sum("d").over(so_far("g", "us")))
        .groupBy(pod, "g").agg(F.sum("d").alias("d"), F.min("low").alias("low")))
    # sums and lowest sums from the start of each hour
    hour = max(1, 3600 // step_s)
    net = (
        steps.withColumn("h", F.expr(f"g div {hour}"))
        .withColumn("sum", F.sum("d").over(so_far("h", "g")))
        .withColumn("low", F.col("sum") - F.col("d") + F.col("low")))
    # one row per pod and hour with what holds at its start; only then its steps
    by_hour = net.groupBy(pod, "h").agg(
        F.sum("d").alias("d"), F.min("low").alias("low"), F.min("g").alias("lo"), F.max("g").alias("hi"))
    spans = by_hour.groupBy(pod).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = Window.partitionBy(pod).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        spans.withColumn("h", F.explode(F.expr(f"sequence(lo div {hour}, hi div {hour})")))
        .join(by_hour.select(F.col(pod).alias("_p"), F.col("h").alias("_h"), "d", "low"),
              F.col(pod).eqNullSafe(F.col("_p")) & (F.col("h") == F.col("_h")), "left").drop("_p", "_h")
        .withColumn("at_start", F.coalesce(F.sum("d").over(before), F.lit(0)))
        .withColumn("low_before", F.min(F.col("at_start") + F.col("low")).over(before)))
    # spread the hours before they unfold: they sit with their pod
    grid = hours.repartition(width(calls.sparkSession), pod, "h").select(
        pod, "h", "at_start", "low_before", F.explode(F.sequence(
            F.greatest("lo", F.col("h") * hour), F.least("hi", F.col("h") * hour + (hour - 1)))).alias("g"))
    inside = so_far("h", "g")
    series = (
        grid.join(net.select(F.col(pod).alias("_p"), F.col("g").alias("_g"), "sum", "low"),
                  F.col(pod).eqNullSafe(F.col("_p")) & (F.col("g") == F.col("_g")), "left")
        .withColumn("sum", F.col("at_start") + F.coalesce(F.last("sum", True).over(inside), F.lit(0)))
        .withColumn("low", F.least(F.lit(0), "low_before", F.col("at_start") + F.min("low").over(inside))))
    return series.select(
        pod, F.timestamp_micros(F.col("g") * step).alias("ts"), (F.col("sum") - F.col("low")).cast("bigint").alias("depth"))


def moving_avg(samples: DataFrame, sizes: dict[str, int] | None = None, pod: str = "pod",
               step_s: int | None = None) -> DataFrame:
    """Averages over the last 12 and 60 samples (one and five minutes), partial at the start.

    ``step_s`` says that every pod has a sample at every step, as :func:`queue_depth` gives
    them; without it the samples are numbered first.
    """
    number = F.expr(f"unix_micros(ts) div {step_s * 1_000_000}") if step_s else None
    return trailing_mean(
        samples, "depth", [pod], ["ts"], time_bucket("ts", 3600), sizes or {"avg_1m": 12, "avg_5m": 60}, number)


def breach_flags(averages: DataFrame, up: float = _CONFIG.scale_up, down: float = _CONFIG.scale_down) -> DataFrame:
    """up if the one-minute mean is above ``up``, down if the five-minute mean is below ``down``."""
    return averages.withColumn(
        "action",
        F.when(F.col("avg_1m") > up, F.lit("up")).when(F.col("avg_5m") < down, F.lit("down"))
        .otherwise(F.lit("hold")))


def across_pods(averages: DataFrame) -> DataFrame:
    """Per sample time: total depth, mean of the averages."""
    return averages.groupBy("ts").agg(
        F.sum("depth").alias("depth"), F.avg("avg_1m").alias("avg_1m"), F.avg("avg_5m").alias("avg_5m"))
