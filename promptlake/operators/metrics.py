"""Counters, histograms, rates and ratios over served requests.

Input rows: request_id, ts, tier (l1_hash, l2_semantic, llm, rejected), latency_ms,
tokens_in, tokens_out, cost_units, saved_units (integer 1e-8 USD). Everything is first
summed per tier or per time step, which combines before the shuffle; later steps only see
those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.functions.cost import to_usd
from promptlake.operators.ordered import percentiles, running_sum
from promptlake.rules import HIT_RATIO_LEVELS, LATENCY_BUCKETS

HIT_TIERS = ("l1_hash", "l2_semantic")
QUANTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def _is_hit() -> Column:
    return F.col("tier").isin(*HIT_TIERS)


def _is_call() -> Column:
    return F.col("tier") == "llm"


def _served(events: DataFrame) -> DataFrame:
    """Rejected requests have no latency sample."""
    return events.filter(_is_hit() | _is_call()).withColumn(
        "cache_status", F.when(_is_hit(), F.lit("hit")).otherwise(F.lit("miss")))


def hits_by_tier(events: DataFrame) -> DataFrame:
    return events.filter(_is_hit()).groupBy("tier").agg(F.count(F.lit(1)).alias("hits"))


def llm_calls(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(_is_call()).alias("calls"))


def total_cost(events: DataFrame) -> DataFrame:
    return events.agg(to_usd(F.coalesce(
        F.sum(F.when(_is_call(), F.col("cost_units"))), F.lit(0))).alias("cost_usd"))


def saved_by_tier(events: DataFrame) -> DataFrame:
    return events.filter(_is_hit()).groupBy("tier").agg(to_usd(F.sum("saved_units")).alias("saved_usd"))


def tokens_by_type(events: DataFrame) -> DataFrame:
    sums = events.filter(_is_call()).agg(
        F.coalesce(F.sum(F.col("tokens_in").cast("bigint")), F.lit(0)).alias("i"),
        F.coalesce(F.sum(F.col("tokens_out").cast("bigint")), F.lit(0)).alias("o"))
    return sums.select(F.expr("stack(2, 'input', i, 'output', o) as (type, tokens)"))


def _bound_names(bounds) -> list[str]:
    return [str(float(b)) for b in bounds]


def _bucket_counts(bounds) -> list[Column]:
    seconds = F.col("latency_ms") / 1000.0
    return [F.count_if(seconds <= F.lit(float(b))).alias(f"_le{i}") for i, b in enumerate(bounds)]


def latency_histogram(events: DataFrame, bounds=LATENCY_BUCKETS) -> DataFrame:
    """Cumulative buckets per cache status, with the sum and the count."""
    wide = _served(events).groupBy("cache_status").agg(
        *_bucket_counts(bounds), F.count("latency_ms").alias("n"),
        F.sum(F.col("latency_ms") / 1000.0).alias("sum_s"))
    buckets = F.array(
        *[F.struct(F.lit(n).alias("le"), F.col(f"_le{i}").alias("cum"))
          for i, n in enumerate(_bound_names(bounds))],
        F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cum")))
    return wide.select("cache_status", F.explode(buckets).alias("_b"), "n", "sum_s").select(
        "cache_status", "_b.le", "_b.cum", "n", "sum_s")


def histogram_quantile(hist: DataFrame, qs: dict[str, float] = QUANTILES, by=("cache_status",)) -> DataFrame:
    """Quantiles from cumulative buckets: linear inside a bucket, the first one starting at 0;
    beyond the last finite bound that bound is the answer."""
    bound = F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.col("le").cast("double"))
    w = Window.partitionBy(*by).orderBy("_x")
    d = (
        hist.withColumn("_x", bound)
        .withColumn("_lo", F.coalesce(F.lag("_x").over(w), F.lit(0.0)))
        .withColumn("_before", F.coalesce(F.lag("cum").over(w), F.lit(0)))
        .withColumn("_n", F.max("cum").over(Window.partitionBy(*by))))

    def value(q):
        rank = F.col("_n") * F.lit(q)
        inside = F.col("_lo") + (F.col("_x") - F.col("_lo")) * F.try_divide(
            rank - F.col("_before"), F.col("cum") - F.col("_before"))
        answer = F.when(F.col("le") == "+Inf", F.col("_lo")).otherwise(inside)
        return F.min_by(answer, F.when((F.col("cum") >= rank) & (F.col("_n") > 0), F.col("_x")))

    return d.groupBy(*by).agg(*[value(q).alias(name) for name, q in qs.items()])


def latency_percentiles(events: DataFrame, qs: dict[str, float] = QUANTILES) -> DataFrame:
    """Exact percentiles, in milliseconds, beside the bucket estimates."""
    return percentiles(_served(events), "latency_ms", ["cache_status"], qs)


def ratio_level(ratio) -> Column:
    low, mid = HIT_RATIO_LEVELS
    ratio = F.col(ratio) if isinstance(ratio, str) else ratio
    return F.when(ratio < low, F.lit("red")).when(ratio < mid, F.lit("yellow")).when(
        ratio.isNotNull(), F.lit("green"))


def hit_ratio(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits over hits and calls, with the display level."""
    d = events.groupBy(*(by or [])).agg(
        F.count_if(_is_hit()).alias("hits"), F.count_if(_is_call()).alias("calls"))
    d = d.withColumn("hit_ratio", F.try_divide(F.col("hits"), F.col("hits") + F.col("calls")))
    return d.withColumn("level", ratio_level("hit_ratio"))


def cost_share(events: DataFrame) -> DataFrame:
    """Actual against saved cost."""
    d = events.agg(
        F.coalesce(F.sum(F.when(_is_call(), F.col("cost_units"))), F.lit(0)).alias("c"),
        F.coalesce(F.sum(F.when(_is_hit(), F.col("saved_units"))), F.lit(0)).alias("s"))
    pct = lambda x: F.bround(F.try_divide(F.col(x) * 100.0, F.col("c") + F.col("s")), 1)
    return d.select(
        to_usd("c").alias("cost_usd"), to_usd("s").alias("saved_usd"),
        pct("c").alias("cost_pct"), pct("s").alias("saved_pct"))


def metrics_snapshot(events: DataFrame, bounds=LATENCY_BUCKETS) -> DataFrame:
    """All counters and histograms as (metric, labels, value), from one pass over the events."""
    per_tier = events.filter(_is_hit() | _is_call()).groupBy("tier").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost_units").alias("cost"), F.sum("saved_units").alias("saved"),
        F.sum(F.col("tokens_in").cast("bigint")).alias("tin"), F.sum(F.col("tokens_out").cast("bigint")).alias("tout"),
        F.count("latency_ms").alias("lat_n"), F.sum(F.col("latency_ms") / 1000.0).alias("lat_sum"),
        *_bucket_counts(bounds))
    row = lambda name, labels, value: F.struct(
        F.lit(name).alias("metric"), labels.alias("labels"), value.cast("double").alias("value"))
    none = F.create_map().cast("map<string,string>")
    tier = F.create_map(F.lit("tier"), F.col("tier"))
    status = F.when(_is_hit(), F.lit("hit")).otherwise(F.lit("miss"))
    label = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    hit_rows = [row("cache_hits_total", tier, F.col("n")), row("cost_saved_usd", tier, to_usd("saved"))]
    call_rows = [
        row("api_calls_total", none, F.col("n")), row("total_cost_usd", none, to_usd("cost")),
        row("tokens_total", label("type", "input"), F.col("tin")),
        row("tokens_total", label("type", "output"), F.col("tout"))]
    lat_rows = [
        row("latency_seconds_bucket", label("cache_status", status, "le", n), F.col(f"_le{i}"))
        for i, n in enumerate(_bound_names(bounds))]
    lat_rows += [
        row("latency_seconds_bucket", label("cache_status", status, "le", "+Inf"), F.col("lat_n")),
        row("latency_seconds_count", label("cache_status", status), F.col("lat_n")),
        row("latency_seconds_sum", label("cache_status", status), F.col("lat_sum"))]
    rows = F.when(_is_hit(), F.array(*hit_rows, *lat_rows)).otherwise(F.array(*call_rows, *lat_rows))
    long = per_tier.select(F.explode(rows).alias("_r")).select("_r.*")
    # maps do not group: group by their text form and keep one map
    return (
        long.withColumn("_k", F.to_json("labels"))
        .groupBy("metric", "_k").agg(F.first("labels").alias("labels"), F.sum("value").alias("value"))
        .select("metric", "labels", "value"))


# --- over time --------------------------------------------------------------------------


def _windows(events: DataFrame, aggs: list[Column], sums: list[str], by: list[str], step_s: int,
             span_s: int) -> DataFrame:
    """Aggregates over (t - span, t] at every step t. Events are summed per step first; only
    those sums are repeated into the windows they fall into."""
    steps = F.ceil(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_s * 1_000_000)).cast("bigint")
    bins = events.groupBy(*by, steps.alias("_g")).agg(*aggs)
    spread = bins.withColumn("_t", F.explode(F.sequence(F.col("_g"), F.col("_g") + (span_s // step_s - 1))))
    return spread.groupBy(*by, "_t").agg(*[F.sum(c).alias(c) for c in sums]).withColumn(
        "ts", F.timestamp_micros(F.col("_t") * (step_s * 1_000_000))).drop("_t")


def rate_5m(events: DataFrame, step_s: int = 15, span_s: int = 300) -> DataFrame:
    """Hits and calls per second and their ratio over the last five minutes, every 15 s."""
    d = _windows(
        events, [F.count_if(_is_hit()).alias("hits"), F.count_if(_is_call()).alias("calls")],
        ["hits", "calls"], [], step_s, span_s)
    ratio = F.try_divide(F.col("hits"), F.col("hits") + F.col("calls"))
    return d.select(
        "ts", (F.col("hits") / float(span_s)).alias("hits_per_s"),
        (F.col("calls") / float(span_s)).alias("calls_per_s"),
        ratio.alias("hit_ratio"), ratio_level(ratio).alias("level"))


def latency_quantiles_5m(events: DataFrame, qs: dict[str, float] = QUANTILES, bounds=LATENCY_BUCKETS,
                         step_s: int = 15, span_s: int = 300) -> DataFrame:
    """Bucket quantiles of the last five minutes, every 15 s, per cache status."""
    names = [f"_le{i}" for i in range(len(bounds))]
    d = _windows(_served(events), [*_bucket_counts(bounds), F.count("latency_ms").alias("n")],
                 [*names, "n"], ["cache_status"], step_s, span_s)
    buckets = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(n).alias("cum")) for b, n in zip(_bound_names(bounds), names)],
        F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("cum")))
    hist = d.select("cache_status", "ts", F.explode(buckets).alias("_b")).select("cache_status", "ts", "_b.*")
    return histogram_quantile(hist, qs, by=("cache_status", "ts"))


def cumulative_cost(events: DataFrame, step_s: int = 60) -> DataFrame:
    """Running actual and saved cost, one row per minute with traffic."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(step_s * 1_000_000)).cast("bigint")
    per = events.groupBy(minute.alias("_m")).agg(
        F.coalesce(F.sum(F.when(_is_call(), F.col("cost_units"))), F.lit(0)).alias("c"),
        F.coalesce(F.sum(F.when(_is_hit(), F.col("saved_units"))), F.lit(0)).alias("s"))
    day = F.floor(F.col("_m") * step_s / 86400).cast("bigint")
    d = running_sum(per, F.col("c"), [], ["_m"], day, "_cost")
    d = running_sum(d, F.col("s"), [], ["_m"], day, "_saved")
    return d.select(
        F.timestamp_seconds(F.col("_m") * step_s).alias("ts"),
        to_usd("_cost").alias("cost_usd"), to_usd("_saved").alias("saved_usd"))


def series_summary(series: DataFrame) -> DataFrame:
    """Last non-null, largest and mean value per metric of (metric, ts, value)."""
    return series.filter(F.col("value").isNotNull()).groupBy("metric").agg(
        F.max_by("value", "ts").alias("last"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def status_snapshot(l1_store: DataFrame, l2_store: DataFrame, averages: DataFrame, quota: int,
                    at: Column) -> DataFrame:
    """Live entries per store at a time, current depth and averages, and the quota limit."""
    live = lambda df, name: df.filter((F.col("stored_at") <= at) & (at < F.col("expires_at"))).agg(
        F.lit(name).alias("item"), F.count(F.lit(1)).cast("double").alias("value"))
    last = averages.filter(F.col("ts") <= at).groupBy("pod").agg(
        F.max_by(F.struct("depth", "avg_1m", "avg_5m"), "ts").alias("l")).agg(
        F.sum("l.depth").cast("double").alias("d"), F.bround(F.avg("l.avg_1m"), 2).alias("a1"),
        F.bround(F.avg("l.avg_5m"), 2).alias("a5"))
    queue = last.select(F.expr(
        "stack(3, 'current_depth', d, 'avg_1m', a1, 'avg_5m', a5) as (item, value)"))
    limit = averages.sparkSession.range(1).select(
        F.lit("quota_limit").alias("item"), F.lit(float(quota)).alias("value"))
    return live(l1_store, "l1_entries").unionByName(live(l2_store, "l2_entries")).unionByName(
        queue).unionByName(limit)


def duplicate_share(requests: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests, distinct prompts, and the share of repeats, which bounds the exact tier's use."""
    per_key = requests.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.sum("c").alias("requests"), F.count(F.lit(1)).alias("distinct_prompts"),
        F.bround((F.sum("c") - F.count(F.lit(1))) * 100.0 / F.sum("c"), 1).alias("duplicate_pct"))


def duplicate_share_approx(requests: DataFrame, key: str = "cache_key", rsd: float = 0.02) -> DataFrame:
    """The same from a sketch: one small buffer per task instead of a shuffle of keys."""
    d = requests.agg(F.count(F.lit(1)).alias("requests"),
                     F.approx_count_distinct(key, rsd).alias("distinct_prompts"))
    return d.withColumn("duplicate_pct", F.bround(
        (F.col("requests") - F.col("distinct_prompts")) * 100.0 / F.col("requests"), 1))
