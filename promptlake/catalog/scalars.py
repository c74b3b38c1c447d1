"""Column functions over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from promptlake.catalog.base import (
    CHAT, RULES, TEXTS, VERSION_RE, YEAR_RE, answers, chat_requests, events, load, quoted, sql_class,
    sql_keywords, sql_numbers, sql_tokens, sql_words, texts)
from promptlake.functions import cost, quota, text as T, validate as V
from promptlake.functions.keys import l1_key
from promptlake.functions.vector import cosine_sim

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _doc_query(name, build, sql_cols):
    """A query over the whole documents table: doc_id and computed columns."""
    QUERIES[name] = lambda s, d: load(s, d, "documents").select("doc_id", *[c.alias(n) for n, c in build().items()])
    ORACLES[name] = "SELECT doc_id, " + ", ".join(f"{v} AS {k}" for k, v in sql_cols.items()) + " FROM documents"


@query("query_text", f"WITH {CHAT} SELECT request_id, text AS query_text FROM chat")
def _(s, d):
    return chat_requests(s, d).select("request_id", T.query_text().alias("query_text"))


@query("l1_key", f"WITH {CHAT} SELECT request_id, 'llm:cache:' || md5('[' || body || ']') AS cache_key FROM chat")
def _(s, d):
    return chat_requests(s, d).select("request_id", l1_key().alias("cache_key"))


def _sql_normalize(text):
    for t in sorted(RULES.term_map, key=len, reverse=True):
        text = f"regexp_replace({text}, {quoted('(?i)' + chr(92) + 'b' + re.escape(t) + chr(92) + 'b')}, {quoted(RULES.term_map[t])}, 'g')"
    return text


@query("normalize", f"""WITH {TEXTS}, n AS (SELECT src, id, text, {_sql_normalize('text')} AS norm FROM texts)
  SELECT src, id, norm <> text AS changed, md5(norm) AS norm_md5 FROM n""")
def _(s, d):
    n = texts(s, d).withColumn("norm", T.normalize("text"))
    return n.select("src", "id", (F.col("norm") != F.col("text")).alias("changed"), F.md5("norm").alias("norm_md5"))


_doc_query("l2_eligible", lambda: {"eligible": T.l2_eligible("text")}, {"eligible": "length(text) <= 300"})
_doc_query("estimate_tokens", lambda: {"tokens": cost.estimate_tokens("text")}, {"tokens": sql_tokens("text")})
_doc_query("classify_query", lambda: {"query_type": T.classify_query("text")}, {"query_type": sql_class("text", 0)})
_doc_query("predict_output_tokens", lambda: {"predicted_max": T.predict_output_tokens("text")},
           {"predicted_max": sql_class("text", 1)})
_doc_query("token_limit", lambda: {"token_limit": cost.token_limit(T.predict_output_tokens("text"))},
           {"token_limit": f"CAST(floor(1.5 * ({sql_class('text', 1)})) AS INTEGER)"})
_doc_query("cost_usd", lambda: {"cost_usd": cost.cost_usd(cost.estimate_tokens("text"), F.col("n_chars"))},
           {"cost_usd": f"(50 * {sql_tokens('text')} + 150 * n_chars) / 1e8"})
_doc_query("cost_saved", lambda: {"saved_usd": cost.cost_saved("text")},
           {"saved_usd": f"(50 * {sql_tokens('text')} + 150 * ({sql_class('text', 1)})) / 1e8"})
_doc_query("mock_answer", lambda: {"answer": T.mock_answer("text", F.col("source"))},
           {"answer": "'[MOCK] ''' || substr(text, 1, 50) || '...''에 대한 응답입니다. (model=' || source || ')'"})
_doc_query("resolved_model",
           lambda: {"own": cost.resolved_model("source", "m1"), "asked": cost.resolved_model("source", "")},
           {"own": "'m1'", "asked": "source"})
_doc_query("estimated_tokens",
           lambda: {"tokens_in": cost.estimated_input_tokens("text", T.normalize("text"), T.l2_eligible("text")),
                    "tokens_out": cost.estimate_tokens(T.mock_answer("text", F.col("source")))},
           {"tokens_in": f"CASE WHEN length(text) <= 300 THEN {sql_tokens(_sql_normalize('text'))} ELSE {sql_tokens('text')} END",
            "tokens_out": sql_tokens("('[MOCK] ''' || substr(text, 1, 50) || '...''에 대한 응답입니다. (model=' || source || ')')")})

def _text_query(name, build, sql):
    QUERIES[name] = lambda s, d: texts(s, d).select("src", "id", F.array_join(build("text"), ",").alias("found"))
    ORACLES[name] = f"WITH {TEXTS} SELECT src, id, array_to_string({sql}, ',') AS found FROM texts"


_text_query("years", T.years, f"regexp_extract_all(text, {YEAR_RE})")
_text_query("versions", T.versions, f"regexp_extract_all(text, {VERSION_RE})")
_text_query("tech_keywords", T.tech_keywords, sql_words("text"))
_text_query("extract_keywords", T.extract_keywords,
            sql_keywords("text"))


def _cases(s, d):
    """Each page as a query against the entry made of the next page."""
    p, docs = load(s, d, "pages").select("page_id", "html"), load(s, d, "documents").select("doc_id", "lang")
    q = p.join(docs, p.page_id == docs.doc_id, "left").select("page_id", F.col("html").alias("query_text"), "lang")
    e = p.join(docs, p.page_id == docs.doc_id, "left").select(
        (F.col("page_id") - 1).alias("page_id"), F.col("lang").alias("entry_lang"),
        T.extract_keywords("html").alias("entry_keywords"))
    return q.join(e, "page_id")


_CASES = f"""cases AS (
  SELECT q.page_id, q.html AS query_text, coalesce(dq.lang, '') AS lang, coalesce(de.lang, '') AS entry_lang,
    array_to_string({sql_keywords('e.html')}, ' ') AS kws
  FROM pages q JOIN pages e ON e.page_id = q.page_id + 1
  LEFT JOIN documents dq ON dq.doc_id = q.page_id LEFT JOIN documents de ON de.doc_id = e.page_id),
sets AS (SELECT *, {sql_numbers('query_text')} AS qn, {sql_numbers('kws')} AS en,
  {sql_words('query_text')} AS qt, {sql_words('kws')} AS et FROM cases)"""
_LANG = "CASE WHEN lang = '' OR entry_lang = '' THEN 'lang_unknown_skip' WHEN lang = entry_lang THEN 'lang_match' ELSE 'lang_mismatch' END"
_NUM = "CASE WHEN len(qn) = 0 THEN 'no_numeric_in_query' WHEN qn = en THEN 'numeric_match' ELSE 'numeric_mismatch' END"
_TECH = "CASE WHEN len(qt) = 0 THEN 'no_tech_keyword_in_query' WHEN qt = et THEN 'tech_keyword_match' ELSE 'tech_keyword_mismatch' END"


def _check(name, build, sql):
    QUERIES[name] = lambda s, d: _cases(s, d).select("page_id", build().alias("v")).select("page_id", "v.passed", "v.reason")
    ORACLES[name] = f"WITH {_CASES}, r AS (SELECT page_id, {sql} AS reason FROM sets) SELECT page_id, reason NOT LIKE '%mismatch' AS passed, reason FROM r"


_check("check_language", V.check_language, _LANG)
_check("check_numeric", V.check_numeric, _NUM)
_check("check_tech", V.check_tech, _TECH)
_check("validate", V.validate,
       f"CASE WHEN {_LANG} LIKE '%mismatch' THEN {_LANG} WHEN {_NUM} LIKE '%mismatch' THEN {_NUM} "
       f"WHEN {_TECH} LIKE '%mismatch' THEN {_TECH} ELSE 'all_checks_passed' END")


@query("cosine_sim", """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(s, d):
    e = load(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", cost.fmt_sim(cosine_sim("embedding", "other")).alias("similarity"))


@query("quota_month", """SELECT event_id, strftime(ts, '%Y%m') AS month,
  CAST(epoch(date_trunc('month', ts) + INTERVAL 1 MONTH) AS BIGINT) - 1 AS month_end_s FROM events""")
def _(s, d):
    return events(s, d).select("event_id", quota.quota_month().alias("month"),
                               F.unix_timestamp(quota.month_end()).alias("month_end_s"))


@query("quota_status", """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(ts, '%Y%m') AS month,
    CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS usage FROM events GROUP BY 1, 2)
  SELECT user_id, month, usage, CASE WHEN usage >= 4000 THEN 'EXCEEDED' WHEN usage >= 3200 THEN 'WARNING' ELSE 'OK' END AS status,
    greatest(0, 4000 - usage) AS remaining FROM u""")
def _(s, d):
    u = events(s, d).groupBy(F.col("user_id").cast("string").alias("user_id"), quota.quota_month().alias("month")).agg(
        F.sum(F.floor("value").cast("bigint")).alias("usage"))
    return u.select("user_id", "month", "usage", quota.quota_status("usage", 4000).alias("status"),
                    quota.quota_remaining("usage", 4000).alias("remaining"))


_ANSWERS = f"""WITH {CHAT}, ans AS (SELECT c.*, a.text AS content FROM chat c LEFT JOIN conversations a
  ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant')"""


@query("billed_tokens", _ANSWERS + f""" SELECT request_id,
    CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id + turn AS INTEGER) ELSE CAST({sql_tokens('joined')} AS INTEGER) END AS tokens_in,
    CASE WHEN conv_id % 3 = 0 THEN CAST(turn AS INTEGER) ELSE CAST({sql_tokens("coalesce(content, '')")} AS INTEGER) END AS tokens_out
  FROM ans""")
def _(s, d):
    # measured usage is present for some conversations only
    a = answers(s, d).withColumns({
        "content": F.coalesce("content", F.lit("")),
        "prompt_tokens": F.when(F.col("conv_id") % 2 == 0, F.col("conv_id") + F.col("turn")),
        "completion_tokens": F.when(F.col("conv_id") % 3 == 0, F.col("turn"))})
    return a.select("request_id", cost.billed_input_tokens().alias("tokens_in"),
                    cost.billed_output_tokens().alias("tokens_out"))


@query("rounding", """SELECT event_id, round_even(value / 3, 2) AS ms, round_even(value / 500, 4) AS sim,
  round_even(value / 5, 1) AS pct FROM events""")
def _(s, d):
    return load(s, d, "events").select(
        "event_id", cost.fmt_ms(F.col("value") / 3).alias("ms"), cost.fmt_sim(F.col("value") / 500).alias("sim"),
        cost.fmt_pct(F.col("value") / 5).alias("pct"))
