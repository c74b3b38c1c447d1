"""Store tables of the exact and the vector tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from promptlake.config import Config
from promptlake.functions.text import extract_keywords, l2_eligible
from promptlake.rules import Rules

_CONFIG = Config()
_RULES = Rules()


def _expiry(stored_at: Column, ttl: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(stored_at) + ttl.cast("bigint") * 1_000_000)


def l1_store_build(served: DataFrame, ttl_s: int = 86400, ttl_col: str | None = None,
                   key: str = "cache_key", ts: str = "ts", rid: str = "request_id") -> DataFrame:
    """Last write per key wins. An aggregate, so copies of a key combine before the shuffle."""
    ttl = F.coalesce(F.col(ttl_col), F.lit(ttl_s)) if ttl_col else F.lit(ttl_s)
    last = F.max_by(
        F.struct(F.col("content"), F.col(ts).alias("stored_at"), ttl.alias("ttl")),
        F.struct(F.col(ts), F.col(rid)))
    return (
        served.groupBy(F.col(key).alias("cache_key")).agg(last.alias("_w"))
        .select(
            "cache_key", "_w.content", "_w.stored_at",
            _expiry(F.col("_w.stored_at"), F.col("_w.ttl")).alias("expires_at")))


def l2_store_build(served: DataFrame, ttl_s: int = 86400, max_chars: int = _CONFIG.max_chars,
                   rules: Rules = _RULES) -> DataFrame:
    """One entry per short answered request; keywords come from the raw query text."""
    return served.filter(
        l2_eligible("query_text", max_chars) & F.col("embedding").isNotNull()
    ).select(
        F.col("request_id").alias("entry_id"), "embedding", "content", "model", "lang",
        extract_keywords("query_text", rules).alias("keywords"),
        F.col("ts").alias("stored_at"),
        _expiry(F.col("ts"), F.lit(ttl_s)).alias("expires_at"))


def write_store(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, split by day of storage, so that expiry tests prune whole folders."""
    df.withColumn("stored_day", F.to_date("stored_at")).write.partitionBy("stored_day").mode(
        mode).parquet(path)
