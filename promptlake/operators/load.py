"""Load-test samples: rates, service levels, stages, endpoints, cost projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.operators.ordered import join_null_safe, percentiles
from promptlake.rules import Rules, rule_frames

_RULES = Rules()


def _share(cond):
    return F.avg(cond.cast("int"))


def _failed():
    return (F.col("status") < 200) | (F.col("status") >= 400)


def load_rates(samples: DataFrame, by: tuple = ("scenario",)) -> DataFrame:
    """Rates per scenario; cache rates count answered requests only."""
    s, ok = F.col("status"), F.col("status") == 200
    return samples.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _share(_failed()).alias("error_rate"),
        F.avg(F.when(ok, F.col("cached").cast("int"))).alias("cache_hit_rate"),
        F.avg(F.when(ok, (~F.col("cached")).cast("int"))).alias("llm_call_rate"),
        _share(s == 429).alias("quota_exceeded_rate"),
        _share(s >= 500).alias("server_error_rate"),
        _share(ok | (s == 429)).alias("ok_or_quota_rate"))


def slo_metrics(samples: DataFrame, compat_api: str = "ollama_chat") -> DataFrame:
    """(scenario, metric, value) of everything the service levels refer to."""
    rates = load_rates(samples).select("scenario", F.expr(
        "stack(2, 'error_rate', error_rate, 'server_error_rate', server_error_rate) as (metric, value)"))
    p = percentiles(samples, "duration_ms", ["scenario"], {"p95": 0.95, "p99": 0.99}).select(
        "scenario", F.expr("stack(2, 'p95_ms', p95, 'p99_ms', p99) as (metric, value)"))
    compat = percentiles(
        samples.filter(F.col("api") == compat_api), "duration_ms", ["scenario"], {"p95": 0.95}).select(
        "scenario", F.lit("compat_p95_ms").alias("metric"), F.col("p95").alias("value"))
    return rates.unionByName(p).unionByName(compat)


def slo_check(samples: DataFrame, rules: Rules = _RULES) -> DataFrame:
    """One row per service level: value, bound and whether it is met."""
    slo = F.broadcast(rule_frames(samples.sparkSession, rules)["slo_rules"])  # size checked by Rules
    v, b = F.col("value"), F.col("bound")
    met = (F.when(F.col("op") == "<", v < b).when(F.col("op") == "<=", v <= b)
           .when(F.col("op") == ">", v > b).when(F.col("op") == ">=", v >= b))
    return slo_metrics(samples).join(slo, ["scenario", "metric"]).select(
        "scenario", "metric", "value", "op", "bound", met.alias("met"))


def by_stage(samples: DataFrame, rules: Rules = _RULES) -> DataFrame:
    """Statistics per scenario and load stage; samples after the last stage have stage 0."""
    stages = F.broadcast(rule_frames(samples.sparkSession, rules)["stages"])  # size checked by Rules
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = samples.groupBy("scenario").agg(F.min(us).alias("_start"))
    d = samples.join(start, "scenario").withColumn("_off", (us - F.col("_start")) / 1e6)
    staged = d.join(stages.withColumnRenamed("scenario", "_s"),
                    (F.col("scenario") == F.col("_s")) & (F.col("_off") >= F.col("start_s"))
                    & (F.col("_off") < F.col("end_s")), "left").withColumn("stage", F.coalesce("stage", F.lit(0)))
    keys = ["scenario", "stage"]
    plain = staged.groupBy(*keys).agg(
        F.max("target").alias("target"), _share(_failed()).alias("error_rate"),
        F.avg("duration_ms").alias("mean_ms"))
    return join_null_safe(plain, percentiles(staged, "duration_ms", keys, {"p95_ms": 0.95}), keys)


def by_endpoint(samples: DataFrame) -> DataFrame:
    """Requests and exact latency percentiles per endpoint and status."""
    return percentiles(samples, "duration_ms", ["api", "status"], {"p50_ms": 0.5, "p95_ms": 0.95})


def project_monthly_cost(params: DataFrame, days: int = 30) -> DataFrame:
    """Monthly cost with and without the cache, from requests_per_day, hit_ratio, tokens_in,
    tokens_out, cached_tokens_out (output per remaining call), price_in_1k, price_out_1k."""
    cost = lambda n, out: n * (
        F.col("tokens_in") * F.col("price_in_1k") + F.col(out) * F.col("price_out_1k")) / 1000.0
    all_ = F.col("requests_per_day") * float(days)
    d = params.withColumn("cost_without", cost(all_, "tokens_out")).withColumn(
        "cost_with", cost(all_ * (1.0 - F.col("hit_ratio")), "cached_tokens_out"))
    d = d.withColumn("saving", F.col("cost_without") - F.col("cost_with"))
    return d.withColumn("saving_pct", F.bround(F.try_divide(F.col("saving") * 100.0, F.col("cost_without")), 1))
