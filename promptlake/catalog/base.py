"""Request logs and other inputs derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from promptlake.config import Config
from promptlake.functions.cost import cost_usd, estimate_tokens, to_units
from promptlake.functions.keys import l1_key
from promptlake.functions.text import predict_output_tokens
from promptlake.plans.attribute import attribute_exact
from promptlake.rules import Rules
from promptlake.session import cut, width

RULES = Rules()
CFG = Config()
FEW_IDS = 1 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_wide(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for work that is heavy per row: one held in few files is spread over all cores."""
    df = load(spark, sf_dir, name)
    if len(df.inputFiles()) < spark.sparkContext.defaultParallelism:
        df = df.repartition(width(spark), key)
    return df


def events(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def texts(spark, sf_dir) -> DataFrame:
    """Documents and raw pages as one text table (src, id, text)."""
    d = load_wide(spark, sf_dir, "documents", "doc_id").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    p = load_wide(spark, sf_dir, "pages", "page_id").select(F.lit("page").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    return d.unionByName(p)


def prompts(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document, with what depends on its text computed once, not per request."""
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")))
    d = documents.select(
        "doc_id", "lang", "text", l1_key(message).alias("cache_key"),
        estimate_tokens("text").alias("tokens_in"), predict_output_tokens("text").alias("tokens_out"))
    return d.select(
        "doc_id", "lang", "cache_key", "tokens_in", "tokens_out",
        to_units(cost_usd("tokens_in", "tokens_out")).alias("saved_units"),
        *([F.col("text").alias("query_text")] if with_text else []))


def request_log(spark, sf_dir, with_text: bool = False) -> DataFrame:
    """One request per event: the document named in ``props`` is its prompt."""
    e = events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("request_id"), "ts",
        F.col("user_id").cast("string").alias("user_id"), F.col("value").alias("latency_ms"),
        F.col("event_type").alias("event_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))
    # texts stay where they are: a short list of ids picks out those that occur as prompts, and by a
    # long one, which leaves few out, all are hashed and counted before rows move
    docs = load(spark, sf_dir, "documents")
    ids = cut(e.select("doc_id").distinct())
    if ids.count() <= FEW_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return e.join(prompts(docs, with_text), "doc_id")


def with_vectors(requests: DataFrame, spark, sf_dir) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return requests.join(v, "doc_id", "left")


def served_log(spark, sf_dir) -> DataFrame:
    """The request log with the exact tier decided."""
    return attribute_exact(request_log(spark, sf_dir).drop("doc_id", "lang"))


def chat_requests(spark, sf_dir) -> DataFrame:
    """One request per user turn, carrying the conversation up to it."""
    c = load(spark, sf_dir, "conversations")
    so_far = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    message = F.struct("role", F.col("text").alias("content"))
    return (
        c.withColumn("messages", F.collect_list(message).over(so_far))
        .filter(F.col("role") == "user")
        .select(F.concat("conv_id", F.lit("-"), "turn").alias("request_id"), "conv_id", "turn", "messages"))


def answers(spark, sf_dir) -> DataFrame:
    """Chat requests with the assistant turn that follows, if any, as their answer."""
    c = load(spark, sf_dir, "conversations").filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("content"))
    return chat_requests(spark, sf_dir).join(c, ["conv_id", "turn"], "left")


def us(col: str):
    return F.unix_micros(F.col(col).cast("timestamp")).alias(f"{col}_us")


# --- the same in SQL --------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_class(text: str, item: int) -> str:
    value = lambda v: quoted(v) if isinstance(v, str) else str(v)
    *ranked, default = RULES.query_classes
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({text}), {quoted(w)})" for w in c[2]) + f" THEN {value(c[item])}"
        for c in ranked)
    return f"CASE {whens} ELSE {value(default[item])} END"


def sql_tokens(text: str) -> str:
    return f"greatest(1, strlen({text}) // 4)"


YEAR_RE = r"'\b(?:19|20)\d{2}\b'"
VERSION_RE = r"'\bv?\d+\.\d+(?:\.\d+)?\b'"


def sql_numbers(text: str) -> str:
    return f"list_sort(list_distinct(list_concat(regexp_extract_all({text}, {YEAR_RE}), regexp_extract_all({text}, {VERSION_RE}))))"


def sql_words(text: str) -> str:
    words = "[" + ", ".join(quoted(w) for w in sorted(RULES.tech_words)) + "]"
    return f"list_filter({words}, lambda w: contains(lower({text}), w))"


def sql_keywords(text: str) -> str:
    return f"list_sort(list_distinct(list_concat({sql_numbers(text)}, {sql_words(text)})))"


TEXTS = """texts AS (SELECT 'doc' AS src, doc_id AS id, text FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages)"""

REQ = f"""req AS (
  SELECT CAST(e.event_id AS VARCHAR) AS request_id, e.ts, CAST(e.user_id AS VARCHAR) AS user_id,
    e.value AS latency_ms, e.event_type, d.doc_id, d.lang, d.text,
    'llm:cache:' || md5('[{{"content": ' || CAST(to_json(d.text) AS VARCHAR) || ', "role": "user"}}]') AS cache_key,
    {sql_tokens('d.text')} AS tokens_in, {sql_class('d.text', 1)} AS tokens_out
  FROM events e JOIN documents d ON d.doc_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT))"""

ANCHORS = """anchors AS (
  SELECT cache_key, min(ts) AS t FROM req GROUP BY cache_key
  UNION ALL
  SELECT q.cache_key, min(q.ts) FROM anchors a JOIN req q
    ON q.cache_key = a.cache_key AND q.ts >= a.t + INTERVAL 1 DAY
  GROUP BY q.cache_key)"""

SERVED = """served AS (
  SELECT r.request_id, r.ts, r.user_id, r.latency_ms, r.cache_key, r.tokens_in, r.tokens_out, r.event_type,
    a.t AS anchor_ts, a.t < r.ts AS l1_hit,
    CASE WHEN a.t < r.ts THEN 'l1_hash' ELSE 'llm' END AS tier,
    CASE WHEN a.t < r.ts THEN 0 ELSE 50 * r.tokens_in + 150 * r.tokens_out END AS cost_units,
    CASE WHEN a.t < r.ts THEN 50 * r.tokens_in + 150 * r.tokens_out ELSE 0 END AS saved_units
  FROM req r ASOF JOIN anchors a ON r.cache_key = a.cache_key AND r.ts >= a.t)"""

WITH_SERVED = f"WITH RECURSIVE {REQ}, {ANCHORS}, {SERVED} "

CHAT = """chat AS (
  SELECT * FROM (
    SELECT conv_id || '-' || turn AS request_id, conv_id, turn, role, text,
      list({'role': role, 'content': text}) OVER w AS messages,
      string_agg('{"content": ' || CAST(to_json(text) AS VARCHAR) || ', "role": ' || CAST(to_json(role) AS VARCHAR) || '}', ', ') OVER w AS body,
      string_agg(text, ' ') OVER w AS joined
    FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) WHERE role = 'user')"""
