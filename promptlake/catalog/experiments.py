"""Benchmark statistics, confusion counts, threshold sweeps, user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.catalog.base import WITH_SERVED, load, request_log, served_log
from promptlake.catalog.caching import _JUDGED, _judged
from promptlake.functions.text import normalize
from promptlake.operators import experiment as E
from promptlake.operators.user_functions import answer, embed

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _results(s, d):
    """The request log as a benchmark run; every 101st request failed."""
    return served_log(s, d).select(
        F.col("l1_hit").alias("cached"), "latency_ms",
        F.when(F.col("request_id").cast("bigint") % 101 == 0, F.lit("timeout")).alias("error"))


def _stat(kind, flag):
    cond = f"FILTER (error IS NULL AND {flag})"
    n = f"CAST(floor((count(*) {cond}) * 0.95::DOUBLE) AS BIGINT)"
    return (f"coalesce(round_even(avg(latency_ms) {cond}, 1), 0) AS {kind}_mean, coalesce(round_even(quantile_cont(latency_ms, 0.5) {cond}, 1), 0) AS {kind}_median, "
            f"coalesce(round_even((list_sort(list(latency_ms) {cond}))[{n} + 1], 1), 0) AS {kind}_p95, "
            f"coalesce(round_even(min(latency_ms) {cond}, 1), 0) AS {kind}_min, coalesce(round_even(max(latency_ms) {cond}, 1), 0) AS {kind}_max")


_BENCH = WITH_SERVED + f""", res AS (SELECT l1_hit AS cached, latency_ms, CASE WHEN CAST(request_id AS BIGINT) % 101 = 0 THEN 'timeout' END AS error FROM served),
  st AS (SELECT count(*) AS total_requests, count(*) FILTER (error IS NULL) AS valid_requests, count(error) AS error_count,
    count(*) FILTER (error IS NULL AND cached) AS cache_hits, count(*) FILTER (error IS NULL AND NOT cached) AS cache_misses,
    {_stat('miss', 'NOT cached')}, {_stat('hit', 'cached')} FROM res)"""


@query("bench_stats", _BENCH + """ SELECT *, round_even(cache_hits * 100.0 / valid_requests, 1) AS hit_ratio_pct,
    round_even(cache_hits * 100.0 / valid_requests, 1) AS api_reduction_pct FROM st""")
def _(s, d):
    return E.bench_stats(_results(s, d))


@query("speedup", _BENCH + " SELECT miss_mean, hit_mean, round(miss_mean / hit_mean, 6) AS speedup FROM st")
def _(s, d):
    return E.speedup(E.bench_stats(_results(s, d))).withColumn("speedup", F.round("speedup", 6))


# Each odd vector is expected to hit if its label occurs on the even vector before it. Only candidates
# that pass the checks count.
_SCORED = f"""{_JUDGED}, exp AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, a.label = b.label AS expected_hit, CAST(a.label AS VARCHAR) AS category,
    CASE WHEN a.vec_id % 50 = 1 THEN 'timeout' END AS error FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - 1 WHERE a.vec_id % 2 = 1),
  best AS (SELECT qid, max(similarity) AS best_sim FROM judged WHERE reason = 'all_checks_passed' GROUP BY qid),
  scored AS (SELECT exp.*, coalesce(best_sim, -2) AS best_sim, coalesce(best_sim, -2) >= 0.32 AS hit, (coalesce(best_sim, -2) >= 0.32) = expected_hit AS correct FROM exp LEFT JOIN best USING (qid))"""


def _expected(s, d):
    v = load(s, d, "embeddings").select("vec_id", "label")
    odd = v.filter(F.col("vec_id") % 2 == 1)
    prev = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("label").alias("l2"))
    return odd.join(prev, "vec_id").select(
        F.col("vec_id").cast("string").alias("qid"), (F.col("label") == F.col("l2")).alias("expected_hit"),
        F.col("label").cast("string").alias("category"),
        F.when(F.col("vec_id") % 50 == 1, F.lit("timeout")).alias("error"))


def _scored(s, d):
    best = E.best_passing(_judged(s, d, -1.0))
    return E.score_pairs(_expected(s, d), best.withColumn("hit", F.col("best_sim") >= 0.32), "qid")


_COUNTS = """count(*) AS total_pairs, count(*) FILTER (expected_hit AND hit) AS true_positives, count(*) FILTER (NOT expected_hit AND hit) AS false_positives,
  count(*) FILTER (expected_hit AND NOT hit) AS false_negatives, count(*) FILTER (NOT expected_hit) AS neg"""
_RATES = """coalesce(round_even(true_positives * 100.0 / nullif(true_positives + false_negatives, 0), 1), 0) AS hit_ratio_pct,
  coalesce(round_even(false_positives * 100.0 / nullif(neg, 0), 1), 0) AS false_positive_rate_pct,
  coalesce(round_even(false_negatives * 100.0 / nullif(true_positives + false_negatives, 0), 1), 0) AS false_negative_rate_pct"""


@query("score_pairs", f"WITH {_SCORED} SELECT qid, expected_hit, hit, correct FROM scored")
def _(s, d):
    return _scored(s, d).select("qid", "expected_hit", "hit", "correct")


@query("confusion", f"WITH {_SCORED}, c AS (SELECT {_COUNTS} FROM scored WHERE error IS NULL) SELECT c.* EXCLUDE (neg), {_RATES} FROM c")
def _(s, d):
    return E.confusion(_scored(s, d))


_THRESHOLDS = [0.25, 0.28, 0.3, 0.32, 0.35, 0.4]
_SWEEP = f"""{_SCORED}, th AS (SELECT unnest({_THRESHOLDS}::DOUBLE[]) AS threshold),
  sw AS (SELECT threshold, count(*) AS total_pairs, count(*) FILTER (expected_hit AND best_sim >= threshold) AS true_positives,
    count(*) FILTER (NOT expected_hit AND best_sim >= threshold) AS false_positives, count(*) FILTER (expected_hit AND best_sim < threshold) AS false_negatives,
    count(*) FILTER (NOT expected_hit) AS neg FROM scored, th WHERE error IS NULL GROUP BY threshold),
  sweep AS (SELECT sw.* EXCLUDE (neg), {_RATES} FROM sw)"""


@query("threshold_sweep", f"WITH {_SWEEP} SELECT * FROM sweep")
def _(s, d):
    return E.threshold_sweep(_scored(s, d), _THRESHOLDS)


@query("goal_flags", f"""WITH {_SWEEP}, aims AS (SELECT *, hit_ratio_pct >= 40 AS goal_hit, false_positive_rate_pct < 50 AS goal_fp FROM sweep),
  met AS (SELECT *, goal_hit AND goal_fp AS goal_ok FROM aims), b AS (SELECT threshold AS t FROM met WHERE goal_ok ORDER BY hit_ratio_pct DESC, threshold DESC LIMIT 1)
  SELECT threshold, hit_ratio_pct, goal_hit, goal_fp, goal_ok, coalesce(threshold = (SELECT t FROM b), false) AS best FROM met""")
def _(s, d):
    return E.goal_flags(E.threshold_sweep(_scored(s, d), _THRESHOLDS), max_fp=50.0).select(
        "threshold", "hit_ratio_pct", "goal_hit", "goal_fp", "goal_ok", "best")


@query("by_category", f"""WITH {_SCORED} SELECT category, count(*) AS pairs, count(*) FILTER (hit) AS hits, count(*) FILTER (correct) AS correct,
  round_even(count(*) FILTER (correct) * 100.0 / count(*), 1) AS correct_pct FROM scored WHERE error IS NULL GROUP BY category""")
def _(s, d):
    return E.by_category(_scored(s, d))


@query("audit_store", """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 90 = 7 THEN 'timeout' END AS error FROM documents),
  st AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'llm:cache:' ELSE 'llm:vec:' END || doc_id AS store_key FROM labels)
  SELECT 'expected' AS "check", count(*) AS n FROM e UNION ALL SELECT 'stored', count(*) FROM st
  UNION ALL SELECT 'missing', count(*) FROM e WHERE doc_id NOT IN (SELECT doc_id FROM st)
  UNION ALL SELECT 'failed', count(error) FROM e
  UNION ALL SELECT 'prefix ' || split_part(store_key, ':', 1) || ':' || split_part(store_key, ':', 2), count(*) FROM st GROUP BY 1""")
def _(s, d):
    expected = load(s, d, "documents").select(
        F.col("doc_id").alias("entry_id"), F.when(F.col("doc_id") % 90 == 7, F.lit("timeout")).alias("error"))
    store = load(s, d, "labels").select(
        F.col("doc_id").alias("entry_id"),
        F.concat(F.when(F.col("toxic") == 1, "llm:cache:").otherwise("llm:vec:"), F.col("doc_id")).alias("store_key"))
    return E.audit_store(expected, store, error="error")


# --- user functions ---------------------------------------------------------------------


def _letters(texts):
    """A stand-in embedder: letter frequencies."""
    import numpy as np
    out = np.zeros((len(texts), 26), dtype="float32")
    for i, t in enumerate(texts):
        codes = np.frombuffer(t.lower().encode("ascii", "ignore"), dtype="uint8").astype(int) - 97
        np.add.at(out[i], codes[(codes >= 0) & (codes < 26)], 1.0)
    return out


@query("embed")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", normalize("text").alias("text"))
    return embed(docs, lambda: _letters, "text").select("doc_id", "embedding")


@query("answer_misses", WITH_SERVED + """ SELECT request_id, '[MOCK] ''' || substr(text, 1, 50) || '...''에 대한 응답입니다. (model=m1)' AS content,
    CAST(length(text) AS INTEGER) AS input_tokens, 7 AS output_tokens FROM served JOIN req USING (request_id) WHERE NOT l1_hit""")
def _(s, d):
    missed = served_log(s, d).filter(~F.col("l1_hit")).select("request_id")
    r = request_log(s, d, True).join(missed, "request_id", "left_semi").select(
        "request_id", "query_text", F.lit("m1").alias("model"))

    def reply(text, model):
        return f"[MOCK] '{text[:50]}...'에 대한 응답입니다. (model={model})", len(text), 7

    return answer(r, lambda: reply).select("request_id", "content", "input_tokens", "output_tokens")
