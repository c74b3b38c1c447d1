"""Tier attribution: which tier serves each request, at what cost, on whose quota."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.config import Config
from promptlake.functions.cost import cost_usd, to_units
from promptlake.operators.absorb import semantic_absorb
from promptlake.operators.exact_cache import l1_attribute
from promptlake.operators.quota import quota_gate
from promptlake.rules import Rules
from promptlake.session import cut

_CONFIG = Config()
_RULES = Rules()


def attribute_exact(requests: DataFrame, cfg: Config = _CONFIG) -> DataFrame:
    """The exact tier alone: adds tier, cost_units and saved_units.

    Columns needed: request_id, ts, user_id, cache_key, tokens_in, tokens_out, saved_units.
    """
    d = l1_attribute(requests, cfg.ttl_s)
    tier = F.when(F.col("l1_hit"), F.lit("l1_hash")).otherwise(F.lit("llm"))
    return _money(d.withColumn("tier", tier), cfg)


def _money(d: DataFrame, cfg: Config) -> DataFrame:
    call, hit = F.col("tier") == "llm", F.col("tier").isin("l1_hash", "l2_semantic")
    zero = F.lit(0).cast("bigint")
    return d.withColumns({
        "cost_units": F.when(call, to_units(cost_usd("tokens_in", "tokens_out", cfg))).otherwise(zero),
        "saved_units": F.when(hit, F.col("saved_units")).otherwise(zero),
    })


def attribute_tiers(requests: DataFrame, cfg: Config = _CONFIG, rules: Rules = _RULES,
                    semantic: bool = True, **layout) -> DataFrame:
    """All tiers: l1_hash, l2_semantic, llm or rejected per request.

    Columns needed: request_id, ts, user_id, cache_key, tokens_in, tokens_out, saved_units,
    and for the semantic tier query_text, lang and embedding. Texts and vectors are only read
    for requests that reach the semantic tier.

    A rejected request stores nothing, which can turn later hits into misses, which use quota
    in their turn. The tiers are therefore repeated with the rejected requests barred from
    storing, until the rejections stay the same. A row depends on earlier rows only, so the
    settled prefix of the log grows every time and the repetition ends.
    """
    narrow = cut(requests.select(
        F.col("request_id").cast("string").alias("request_id"), "ts", "user_id", "cache_key",
        "tokens_in", "tokens_out", "saved_units"))
    texts = requests.select(F.col("request_id").cast("string").alias("request_id"),
                            "query_text", "lang", "embedding") if semantic else None
    barred = narrow.select("request_id").limit(0)
    while True:
        flagged = narrow.join(barred.withColumn("_barred", F.lit(True)), "request_id", "left").withColumn(
            "can_store", F.col("_barred").isNull()).drop("_barred")
        exact = cut(l1_attribute(flagged, cfg.ttl_s, can_store="can_store"))
        missed = exact.filter(~F.col("l1_hit"))
        if semantic:
            found = semantic_absorb(
                missed.select("request_id", "ts", "can_store").join(texts, "request_id"),
                cfg.threshold, cfg.k, cfg.ttl_s, cfg.max_chars, rules, "can_store", **layout)
            missed = missed.join(found.select("request_id", "l2_hit", "entry_id", "similarity"), "request_id", "left")
        else:
            missed = missed.withColumns({
                "l2_hit": F.lit(False), "entry_id": F.lit(None).cast("string"),
                "similarity": F.lit(None).cast("double")})
        calls = missed.filter(~F.col("l2_hit")).withColumn(
            "tokens", F.col("tokens_in").cast("bigint") + F.col("tokens_out"))
        gated = cut(quota_gate(calls, cfg.quota).select("request_id", "admitted", "status", "used_before"))
        rejected = gated.filter(~F.col("admitted")).select("request_id")
        changed = rejected.exceptAll(barred).unionByName(barred.exceptAll(rejected))
        if changed.isEmpty():
            break
        barred = rejected
    tier = (
        F.when(F.col("l1_hit"), F.lit("l1_hash")).when(F.col("l2_hit"), F.lit("l2_semantic"))
        .when(F.col("admitted"), F.lit("llm")).otherwise(F.lit("rejected")))
    d = exact.join(missed.select("request_id", "l2_hit", "entry_id", "similarity"), "request_id", "left").join(
        gated.withColumnRenamed("status", "quota_status"), "request_id", "left")
    return _money(d.withColumn("tier", tier), cfg).drop("can_store", "l2_hit", "admitted")
