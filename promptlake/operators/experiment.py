"""Scoring of cache experiments: benchmark statistics, confusion counts, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from promptlake.operators.ordered import order_statistics


def _no_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) == ""


def _pct(part, whole) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def bench_stats(results: DataFrame) -> DataFrame:
    """One row: totals, hit share, and latency statistics of hits and misses (errors excluded).

    The 95th percentile is the element at 0-based rank int(n * 0.95).
    """
    valid = results.filter(_no_error()).withColumn("kind", F.when(F.col("cached"), "hit").otherwise("miss"))
    totals = results.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(_no_error()).alias("valid_requests"),
        F.count_if(~_no_error()).alias("error_count"),
        F.count_if(_no_error() & F.col("cached")).alias("cache_hits"),
        F.count_if(_no_error() & ~F.col("cached")).alias("cache_misses"))
    n = F.col("n")
    ranked = order_statistics(valid, "latency_ms", ["kind"], {
        "p95": F.floor(n * F.lit(0.95)), "_m1": F.floor((n - 1) / 2), "_m2": F.floor(n / 2)})
    plain = valid.groupBy("kind").agg(
        F.avg("latency_ms").alias("mean"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"))
    stats = plain.join(ranked, "kind").withColumn("median", (F.col("_m1") + F.col("_m2")) / 2)
    cols = [
        F.coalesce(F.max(F.when(F.col("kind") == kind, F.bround(stat, 1))), F.lit(0.0)).alias(f"{kind}_{stat}")
        for kind in ("miss", "hit") for stat in ("mean", "median", "p95", "min", "max")]
    names = [f"{kind}_{stat}" for kind in ("miss", "hit") for stat in ("mean", "median", "p95", "min", "max")]
    return totals.withColumn("_s", stats.agg(F.struct(*cols)).scalar()).select("*", *[
        F.col("_s")[c].alias(c) for c in names]).drop("_s").withColumns({
        "hit_ratio_pct": F.bround(_pct("cache_hits", "valid_requests"), 1),
        "api_reduction_pct": F.bround(_pct("cache_hits", "valid_requests"), 1),
    })


def speedup(stats: DataFrame) -> DataFrame:
    """Mean miss over mean hit latency, where both are positive."""
    return stats.select("miss_mean", "hit_mean", F.when(
        (F.col("miss_mean") > 0) & (F.col("hit_mean") > 0),
        F.col("miss_mean") / F.col("hit_mean")).alias("speedup"))


def score_pairs(pairs: DataFrame, outcomes: DataFrame, on: str = "pair_id") -> DataFrame:
    """Expected against observed: outcomes carry ``hit`` and optionally ``error``. A pair without
    an outcome found no candidate: no hit."""
    d = pairs.join(outcomes, on, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    if "error" not in d.columns:
        d = d.withColumn("error", F.lit(None).cast("string"))
    return d.withColumn("correct", F.col("hit") == F.col("expected_hit"))


def _rates(d: DataFrame) -> DataFrame:
    pos, neg = F.col("true_positives") + F.col("false_negatives"), F.col("negatives")
    return d.withColumns({
        "hit_ratio_pct": F.bround(_pct("true_positives", pos), 1),
        "false_positive_rate_pct": F.bround(_pct("false_positives", neg), 1),
        "false_negative_rate_pct": F.bround(_pct("false_negatives", pos), 1),
    }).drop("negatives")


def confusion(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True and false positives, false negatives, and rates; failed probes are left out."""
    e, h = F.col("expected_hit"), F.col("hit")
    return _rates(scored.filter(_no_error()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(e & h).alias("true_positives"), F.count_if(~e & h).alias("false_positives"),
        F.count_if(e & ~h).alias("false_negatives"), F.count_if(~e).alias("negatives")))


def best_passing(candidates: DataFrame) -> DataFrame:
    """Per query the best similarity among its candidates that pass the checks."""
    return candidates.filter("passed").groupBy("qid").agg(F.max("similarity").alias("best_sim"))


def threshold_sweep(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Confusion per threshold from ``expected_hit`` and ``best_sim`` (null: no candidate).

    One search serves all thresholds, and one aggregate counts them all: rows are not
    repeated per threshold. Failed probes are left out.
    """
    e, s = F.col("expected_hit"), F.coalesce(F.col("best_sim"), F.lit(-2.0))
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(e & (s >= t)).alias(f"tp{i}"), F.count_if(~e & (s >= t)).alias(f"fp{i}"),
                 F.count_if(e & (s < t)).alias(f"fn{i}")]
    one = scored.filter(_no_error()).agg(F.count(F.lit(1)).alias("total_pairs"), F.count_if(~e).alias("negatives"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("true_positives"),
                 F.col(f"fp{i}").alias("false_positives"), F.col(f"fn{i}").alias("false_negatives"))
        for i, t in enumerate(thresholds)])
    return _rates(one.select("total_pairs", "negatives", F.explode(rows).alias("_r")).select(
        "total_pairs", "negatives", "_r.*"))


def goal_flags(sweep: DataFrame, min_hit: float = 40.0, max_fp: float = 5.0) -> DataFrame:
    """Which thresholds meet both goals, and the best of them (most hits, then the strictest)."""
    d = sweep.withColumns({
        "goal_hit": F.col("hit_ratio_pct") >= min_hit,
        "goal_fp": F.col("false_positive_rate_pct") < max_fp,
    }).withColumn("goal_ok", F.col("goal_hit") & F.col("goal_fp"))
    best = d.filter("goal_ok").agg(
        F.max_by("threshold", F.struct("hit_ratio_pct", "threshold"))).scalar()
    return d.withColumn(
        "best", F.coalesce(F.col("threshold") == best, F.lit(False)))


def by_category(scored: DataFrame) -> DataFrame:
    """Pairs, hits and right decisions per category; failed probes are left out."""
    return scored.filter(_no_error()).groupBy("category").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("hit")).alias("hits"),
        F.count_if(F.col("correct")).alias("correct"),
        F.bround(_pct(F.count_if(F.col("correct")), F.count(F.lit(1))), 1).alias("correct_pct"))


def audit_store(expected: DataFrame, store: DataFrame, on: str = "entry_id", key: str = "store_key",
                error: str | None = None) -> DataFrame:
    """(check, n): expected, stored, missing and failed entries, and entries per key prefix."""
    count = lambda df, name: df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    failed = expected.filter(F.col(error).isNotNull()) if error else expected.filter(F.lit(False))
    prefix = store.groupBy(F.concat(F.lit("prefix "), F.substring_index(key, ":", 2)).alias("check")).agg(
        F.count(F.lit(1)).alias("n"))
    return (
        count(expected, "expected").unionByName(count(store, "stored"))
        .unionByName(count(expected.join(store, on, "left_anti"), "missing"))
        .unionByName(count(failed, "failed")).unionByName(prefix))
