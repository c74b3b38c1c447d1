"""Why a set of paraphrases does or does not hit, and which embedding serves it best."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from promptlake.operators.candidates import semantic_match
from promptlake.operators.similarity import copies, pair_similarity, similar_pairs
from promptlake.rules import Rules

_RULES = Rules()


def diagnose_pairs(pairs: DataFrame, emb_raw: DataFrame, emb_norm: DataFrame, texts: DataFrame,
                   store: DataFrame, threshold: float = 0.75, k: int = 3, rules: Rules = _RULES) -> DataFrame:
    """Per pair (a = original, b = paraphrase): similarities, how many stored originals are
    close to the original, and the outcome of probing the store with the paraphrase.

    ``texts`` holds id, query_text, lang; the store's entry ids are the originals' ids.
    """
    sims = pair_similarity(pairs, emb_raw, emb_norm, threshold=threshold)
    originals = emb_norm.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    close = similar_pairs(originals, threshold)
    members = copies(originals)
    ends = F.explode(F.array(F.struct(F.col("i").alias("rep"), F.col("j_copies").alias("c")),
                             F.struct(F.col("j").alias("rep"), F.col("i_copies").alias("c"))))
    per_rep = (
        close.select(ends.alias("e")).groupBy("e.rep").agg(F.sum("e.c").alias("c"))
        .unionByName(members.groupBy("rep").agg((F.count(F.lit(1)) - 1).alias("c")))
        .groupBy("rep").agg(F.sum("c").alias("close_originals")))
    near = members.join(per_rep, "rep").select(F.col("id").alias("a"), "close_originals")
    probes = emb_norm.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").join(
        texts, "id").select(F.col("id").alias("request_id"), "query_text", "lang", "embedding")
    out = semantic_match(probes, store, threshold, k, rules)
    return (
        sims.join(near, "a", "left").withColumn("close_originals", F.coalesce("close_originals", F.lit(0)))
        .join(out.select(F.col("qid").cast("bigint").alias("b"), "hit", F.col("sid").cast("bigint").alias("entry")), "b", "left")
        .withColumn("hit", F.coalesce("hit", F.lit(False)))
        .withColumn("right_entry", F.coalesce(F.col("entry") == F.col("a"), F.lit(False))))


def compare_models(pairs: DataFrame, models: dict[str, tuple[DataFrame, DataFrame]],
                   threshold: float = 0.75) -> DataFrame:
    """Mean similarities and passes per embedding model, over the same pairs."""
    each = [pair_similarity(pairs, raw, norm, threshold=threshold).withColumn("model", F.lit(name))
            for name, (raw, norm) in models.items()]
    return reduce(lambda x, y: x.unionByName(y), each).groupBy("model").agg(
        F.count(F.lit(1)).alias("pairs"), F.bround(F.avg("sim_before"), 4).alias("mean_before"),
        F.bround(F.avg("sim_after"), 4).alias("mean_after"),
        F.count_if(F.col("passes")).alias("passing"))
