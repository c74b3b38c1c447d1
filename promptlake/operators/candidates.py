"""From ranked neighbours to a hit: threshold, checks, first passing candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.functions.text import let
from promptlake.functions.validate import validate
from promptlake.operators.similarity import knn
from promptlake.rules import Rules

_RULES = Rules()


def filter_threshold(candidates: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Keep similarity >= threshold."""
    return candidates.filter(F.col("similarity") >= threshold)


def attach(candidates: DataFrame, queries: DataFrame, store: DataFrame,
           qid: str = "request_id", sid: str = "entry_id") -> DataFrame:
    """Query text and language, and the entry's language, keywords and content."""
    return (
        candidates
        .join(queries.select(F.col(qid).cast("string").alias("qid"), "query_text", "lang"), "qid")
        .join(store.select(F.col(sid).cast("string").alias("sid"), F.col("lang").alias("entry_lang"),
                           F.col("keywords").alias("entry_keywords"), "content"), "sid"))


def validate_candidates(candidates: DataFrame, rules: Rules = _RULES) -> DataFrame:
    """Adds ``passed`` and ``reason``. Applied after the cut to k: a failing neighbour has used a slot."""
    return candidates.withColumn("_v", validate(rules=rules)).select(
        "*", "_v.passed", "_v.reason").drop("_v")


def pick_hit(candidates: DataFrame) -> DataFrame:
    """First passing candidate by rank, per query."""
    row = F.struct("rank", "sid", "similarity", "content")
    return (
        candidates.filter("passed").groupBy("qid").agg(F.min_by(row, "rank").alias("_h"))
        .select("qid", "_h.*"))


def semantic_match(probes: DataFrame, store: DataFrame, threshold: float = 0.75, k: int = 3,
                   rules: Rules = _RULES, **layout) -> DataFrame:
    """Probes against a fixed store: every probe with ``hit`` and, if any, its entry."""
    found = knn(probes, store, k, threshold, **layout)
    hit = pick_hit(validate_candidates(attach(found, probes, store), rules))
    ids = probes.select(F.col("request_id").cast("string").alias("qid"))
    return ids.join(hit, "qid", "left").withColumn("hit", F.col("sid").isNotNull())


def keyword_matches(df: DataFrame, rid: str, text: str, rules: Rules = _RULES) -> DataFrame:
    """One row per text, category and keyword found."""
    found = let(F.lower(F.col(text)), lambda t: F.array_compact(F.array(*[
        F.when(F.contains(t, F.lit(w)),
               F.struct(F.lit(c).alias("category"), F.lit(w).alias("keyword")))
        for c, ws in rules.keywords.items() for w in ws])))
    return df.select(rid, F.explode(found).alias("_m")).select(rid, "_m.*")
