"""Cache lookups, repeats under a TTL, quota, vector search and tier attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.catalog.base import (
    REQ, RULES, TEXTS, WITH_SERVED, load, load_wide, quoted, request_log, served_log, sql_class, sql_keywords,
    sql_numbers, sql_words, texts, us, with_vectors)
from promptlake.config import Config
from promptlake.functions.text import extract_keywords, predict_output_tokens
from promptlake.operators import candidates as C, exact_cache as X, language, quota, similarity as S, truncate
from promptlake.operators.absorb import semantic_absorb
from promptlake.plans import attribute, diagnose, report
from promptlake.sources import stores

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# --- exact tier -------------------------------------------------------------------------


@query("l1_attribute", WITH_SERVED + " SELECT request_id, l1_hit, epoch_us(anchor_ts) AS anchor_ts_us FROM served")
def _(s, d):
    r = request_log(s, d).select("request_id", "ts", "cache_key")
    return X.l1_attribute(r).select("request_id", "l1_hit", us("anchor_ts"))


@query("l1_attribute_split", WITH_SERVED + " SELECT request_id, l1_hit, epoch_us(anchor_ts) AS anchor_ts_us FROM served")
def _(s, d):
    """Parts of half a TTL, so that many of them have to be opened."""
    r = request_log(s, d).select("request_id", "ts", "cache_key")
    return X.l1_attribute(r, parts=2).select("request_id", "l1_hit", us("anchor_ts"))


def _store(s, d):
    """Exact store after the first half of the month, as (cache_key, content, stored_at, expires_at)."""
    w = served_log(s, d).filter(~F.col("l1_hit")).withColumn("content", F.col("request_id"))
    return stores.l1_store_build(w.filter(F.col("event_type") != "view"), ttl_s=10 * 86400)


_STORE = """store AS (SELECT cache_key, arg_max(request_id, ts) AS content, max(ts) AS stored_at,
  max(ts) + INTERVAL 10 DAY AS expires_at FROM served WHERE NOT l1_hit AND event_type <> 'view' GROUP BY cache_key)"""
_W_STORE = WITH_SERVED + ", " + _STORE


@query("l1_lookup", _W_STORE + """ SELECT r.request_id, s.content, epoch_us(s.stored_at) AS stored_at_us
  FROM req r LEFT JOIN store s ON s.cache_key = r.cache_key""")
def _(s, d):
    return X.l1_lookup(request_log(s, d).select("request_id", "cache_key"), _store(s, d)).select(
        "request_id", "content", us("stored_at"))


_WRITES = """writes AS (SELECT cache_key, request_id AS content, ts AS stored_at, ts + INTERVAL 2 DAY AS expires_at
  FROM req WHERE event_type = 'purchase')"""


@query("l1_lookup_asof", f"""WITH {REQ}, {_WRITES}, m AS (SELECT r.request_id, r.ts, w.* FROM req r
    ASOF LEFT JOIN writes w ON w.cache_key = r.cache_key AND r.ts >= w.stored_at)
  SELECT request_id, CASE WHEN ts < expires_at THEN content END AS content,
    CASE WHEN ts < expires_at THEN epoch_us(stored_at) END AS stored_at_us FROM m""")
def _(s, d):
    r = request_log(s, d).select("request_id", "ts", "cache_key", "event_type")
    w = r.filter(F.col("event_type") == "purchase").select(
        "cache_key", F.col("request_id").alias("content"), F.col("ts").alias("stored_at"),
        (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("expires_at"))
    return X.l1_lookup_asof(r.drop("event_type"), w).select("request_id", "content", us("stored_at"))


@query("served_from_store", _W_STORE + " SELECT request_id FROM req WHERE cache_key IN (SELECT cache_key FROM store)")
def _(s, d):
    return X.served(request_log(s, d).select("request_id", "cache_key"), _store(s, d)).select("request_id")


@query("store_misses", _W_STORE + """ SELECT request_id FROM req
  WHERE cache_key NOT IN (SELECT cache_key FROM store WHERE stored_at < TIMESTAMP '2024-01-25')""")
def _(s, d):
    """Keys written again in the last days, or never, miss the store as it was before."""
    store = _store(s, d).filter(F.col("stored_at") < F.lit("2024-01-25").cast("timestamp"))
    return X.misses(request_log(s, d).select("request_id", "cache_key"), store).select("request_id")


# --- quota and truncation ---------------------------------------------------------------


@query("quota_usage", WITH_SERVED + """ SELECT user_id, strftime(ts, '%Y%m') AS month, CAST(sum(tokens_in + tokens_out) AS BIGINT) AS tokens
  FROM served WHERE NOT l1_hit GROUP BY 1, 2""")
def _(s, d):
    m = served_log(s, d).filter(~F.col("l1_hit")).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
    return quota.quota_usage(m)


@query("quota_gate", WITH_SERVED + """, w AS (SELECT request_id, user_id, ts, tokens_in + tokens_out AS tokens,
    coalesce(sum(tokens_in + tokens_out) OVER (PARTITION BY user_id, strftime(ts, '%Y%m') ORDER BY ts, request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offered FROM served WHERE NOT l1_hit),
  f AS (SELECT user_id, max(offered + tokens) AS final FROM w WHERE offered < 5000 GROUP BY user_id),
  u AS (SELECT request_id, offered < 5000 AS admitted, CAST(CASE WHEN offered < 5000 THEN offered ELSE final END AS BIGINT) AS used_before FROM w JOIN f USING (user_id))
  SELECT request_id, admitted, used_before, CASE WHEN used_before >= 5000 THEN 'EXCEEDED' WHEN used_before >= 4000 THEN 'WARNING' ELSE 'OK' END AS status,
    greatest(0, 5000 - used_before) AS remaining FROM u""")
def _(s, d):
    m = served_log(s, d).filter(~F.col("l1_hit")).select(
        "request_id", "user_id", "ts", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))
    return quota.quota_gate(m, 5000).select("request_id", "admitted", "used_before", "status", "remaining")


def chunks(s, d):
    """The lines of every document, as chunks of an answer. The limit is found before the lines are
    taken apart: after that it would be worked out from the whole text for each line."""
    limited = load(s, d, "documents").select(F.col("doc_id").alias("response_id"), "text", predict_output_tokens("text").alias("predicted_max"))
    return limited.select("response_id", "predicted_max", F.posexplode(F.split("text", "\n")).alias("seq", "delta"))


@query("truncate_stream", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS delta,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq, CAST(floor(1.5 * {sql_class('text', 1)}) AS BIGINT) AS most FROM documents),
  c AS (SELECT *, sum(strlen(delta)) OVER (PARTITION BY doc_id ORDER BY seq) AS b FROM p WHERE delta <> ''),
  t AS (SELECT *, greatest(1, b // 4) AS tokens, min(CASE WHEN greatest(1, b // 4) > most THEN seq END) OVER (PARTITION BY doc_id) AS cut FROM c)
  SELECT doc_id AS response_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = cut THEN delta || '[TRUNCATED]' ELSE delta END AS delta,
    CAST(tokens AS BIGINT) AS tokens_so_far, coalesce(seq = cut, false) AS truncated FROM t WHERE cut IS NULL OR seq <= cut""")
def _(s, d):
    return truncate.truncate_stream(chunks(s, d)).drop("predicted_max")


# --- vector tier ------------------------------------------------------------------------
# Even vectors are stored entries, odd ones are queries.


def _vectors(s, d):
    v = load(s, d, "embeddings")
    docs = load(s, d, "documents").select("doc_id", "text", "lang")
    return v.join(docs, v.vec_id == docs.doc_id, "left").select(
        "vec_id", "embedding", "label", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))


def _probes(s, d):
    return _vectors(s, d).filter(F.col("vec_id") % 2 == 1).select(
        F.col("vec_id").cast("string").alias("request_id"), "embedding", F.col("text").alias("query_text"), "lang")


def _entries(s, d):
    return _vectors(s, d).filter(F.col("vec_id") % 2 == 0).select(
        F.col("vec_id").cast("string").alias("entry_id"), "embedding", F.col("vec_id").cast("string").alias("content"),
        "lang", extract_keywords("text").alias("keywords"))


_SIM = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
_KNN = f"""sims AS (SELECT CAST(a.vec_id AS VARCHAR) AS qid, CAST(b.vec_id AS VARCHAR) AS sid, {_SIM} AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id % 2 = 1 AND b.vec_id % 2 = 0),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, sid) AS rank FROM sims),
  knn AS (SELECT * FROM ranked WHERE rank <= 3)"""


@query("knn", f"WITH {_KNN} SELECT qid, CAST(rank AS INTEGER) AS rank, sid, round(similarity, 4) AS similarity FROM knn")
def _(s, d):
    return S.knn(_probes(s, d), _entries(s, d)).withColumn("similarity", F.round("similarity", 4))


@query("knn_cells", f"WITH {_KNN} SELECT qid, CAST(rank AS INTEGER) AS rank, sid, round(similarity, 4) AS similarity FROM knn WHERE similarity >= 0.3")
def _(s, d):
    """The same search over many cells and small blocks."""
    return S.knn(_probes(s, d), _entries(s, d), threshold=0.3, pivots=12, block_rows=64).withColumn(
        "similarity", F.round("similarity", 4))


@query("filter_threshold", f"WITH {_KNN} SELECT qid, sid, round(similarity, 4) AS similarity FROM knn WHERE similarity >= 0.35")
def _(s, d):
    return C.filter_threshold(S.knn(_probes(s, d), _entries(s, d)), 0.35).select(
        "qid", "sid", F.round("similarity", 4).alias("similarity"))


_CHECKED = f"""v AS (SELECT e.vec_id, coalesce(dd.lang, '') AS lang, coalesce(dd.text, '') AS text FROM embeddings e
    LEFT JOIN documents dd ON dd.doc_id = e.vec_id),
  f AS (SELECT CAST(vec_id AS VARCHAR) AS id, lang, {sql_numbers('text')} AS qn, {sql_words('text')} AS qt, array_to_string({sql_keywords('text')}, ' ') AS kws FROM v),
  g AS (SELECT *, {sql_numbers('kws')} AS en, {sql_words('kws')} AS et FROM f)"""
_JUDGED = f"""{_KNN}, {_CHECKED},
  judged AS (SELECT k.*, CASE WHEN q.lang <> '' AND e.lang <> '' AND q.lang <> e.lang THEN 'lang_mismatch'
      WHEN len(q.qn) > 0 AND q.qn <> e.en THEN 'numeric_mismatch' WHEN len(q.qt) > 0 AND q.qt <> e.et THEN 'tech_keyword_mismatch'
      ELSE 'all_checks_passed' END AS reason
    FROM knn k JOIN g q ON q.id = k.qid JOIN g e ON e.id = k.sid)"""


def _judged(s, d, threshold=0.25):
    p, e = _probes(s, d), _entries(s, d)
    return C.validate_candidates(C.attach(S.knn(p, e, threshold=threshold), p, e))


@query("validate_candidates", f"WITH {_JUDGED} SELECT qid, CAST(rank AS INTEGER) AS rank, sid, reason = 'all_checks_passed' AS passed, reason FROM judged WHERE similarity >= 0.25")
def _(s, d):
    return _judged(s, d).select("qid", "rank", "sid", "passed", "reason")


@query("rank_candidates", f"WITH {_KNN} SELECT qid, sid, CAST(rank AS INTEGER) AS rank FROM ranked WHERE similarity >= 0.3")
def _(s, d):
    return S.rank_candidates(S.above(_probes(s, d), _entries(s, d), 0.3), None).select("qid", "sid", "rank")


_HITS = f"""{_JUDGED}, hits AS (SELECT qid, arg_min(sid, rank) AS sid, min(rank) AS rank FROM judged
  WHERE similarity >= 0.25 AND reason = 'all_checks_passed' GROUP BY qid)"""


@query("pick_hit", f"WITH {_HITS} SELECT qid, sid, CAST(rank AS INTEGER) AS rank FROM hits")
def _(s, d):
    return C.pick_hit(_judged(s, d)).select("qid", "sid", "rank")


@query("semantic_match", f"""WITH {_HITS} SELECT CAST(v.vec_id AS VARCHAR) AS qid, h.sid, h.sid IS NOT NULL AS hit
  FROM embeddings v LEFT JOIN hits h ON h.qid = CAST(v.vec_id AS VARCHAR) WHERE v.vec_id % 2 = 1""")
def _(s, d):
    return C.semantic_match(_probes(s, d), _entries(s, d), 0.25).select("qid", "sid", "hit")


@query("keyword_matches", f"WITH {TEXTS}, kw AS (" + " UNION ALL ".join(
    f"SELECT {quoted(c)} AS category, {quoted(w)} AS keyword" for c, ws in RULES.keywords.items() for w in ws)
    + ") SELECT src || id AS id, category, keyword FROM texts JOIN kw ON contains(lower(text), keyword)")
def _(s, d):
    return C.keyword_matches(texts(s, d).withColumn("id", F.concat("src", "id")), "id", "text")


def _turned(e):
    """A second embedding of the same items: the coordinates that a normalized text would shift."""
    return F.transform(e, lambda x, i: F.when(i < 8, F.lit(0.0).cast("float")).otherwise(x))


_PAIRS = f"""pairs AS (SELECT vec_id AS a, vec_id + 1 AS b, label FROM embeddings WHERE vec_id + 1 IN (SELECT vec_id FROM embeddings)),
  turned AS (SELECT vec_id, list_concat([0::FLOAT,0,0,0,0,0,0,0], embedding[9:]) AS embedding FROM embeddings),
  sims AS (SELECT p.a, p.b, list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) AS sb,
    list_cosine_similarity(CAST(tx.embedding AS DOUBLE[]), CAST(ty.embedding AS DOUBLE[])) AS sa FROM pairs p
    JOIN embeddings x ON x.vec_id = p.a JOIN embeddings y ON y.vec_id = p.b
    JOIN turned tx ON tx.vec_id = p.a JOIN turned ty ON ty.vec_id = p.b)"""


def _pairs(s, d):
    v = load(s, d, "embeddings")
    raw = v.select(F.col("vec_id").alias("id"), "embedding")
    norm = v.select(F.col("vec_id").alias("id"), _turned("embedding").alias("embedding"))
    ids = v.select("vec_id")
    pairs = ids.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b")).join(
        ids.select(F.col("vec_id").alias("b")), "b", "left_semi")
    return pairs, raw, norm


@query("pair_similarity", f"""WITH {_PAIRS} SELECT a, b, round_even(sb, 4) AS sim_before, round_even(sa, 4) AS sim_after,
  round_even(sa - sb, 4) AS sim_delta, sa >= 0.2 AS passes FROM sims""")
def _(s, d):
    return S.pair_similarity(*_pairs(s, d), threshold=0.2).select("a", "b", "sim_before", "sim_after", "sim_delta", "passes")


_CLOSE = f"""close AS (SELECT a.vec_id AS i, b.vec_id AS j, {_SIM} AS similarity FROM embeddings a
  JOIN embeddings b ON b.vec_id < a.vec_id WHERE {_SIM} >= 0.3)"""


@query("similar_pairs", f"WITH {_CLOSE} SELECT i, j, round(similarity, 4) AS similarity FROM close")
def _(s, d):
    p = S.every_similar_pair(load(s, d, "embeddings"), 0.3, "vec_id", pivots=8, block_rows=128)
    return p.select("i", "j", F.round("similarity", 4).alias("similarity"))


@query("similarity_matrix", f"""WITH {_CLOSE} SELECT i, j, round_even(similarity, 4) AS similarity FROM close
  UNION ALL SELECT j, i, round_even(similarity, 4) FROM close UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings""")
def _(s, d):
    return S.similarity_matrix(load(s, d, "embeddings"), 0.3, "vec_id")


@query("vector_copies", """SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY embedding) AS rep FROM embeddings""")
def _(s, d):
    return S.copies(load(s, d, "embeddings"), "vec_id")


@query("knn_lsh")
def _(s, d):
    return S.knn_lsh(_probes(s, d), _entries(s, d), dim=64, tables=12, bits=6)


@query("knn_lsh_recall")
def _(s, d):
    p, e = _probes(s, d), _entries(s, d)
    return S.recall_vs_exact(S.knn_lsh(p, e, dim=64, tables=12, bits=6), S.knn(p, e))


# --- composites -------------------------------------------------------------------------


def _semantic_log(s, d):
    """Request log with text, language and vector; documents stand in for questions, so the
    length limit is one that no text can pass."""
    return with_vectors(request_log(s, d, True), s, d)


_LONG = Config(threshold=0.3, max_chars=2**31 - 1)


# One request after the other, in order of time: ``stored`` holds for each one before whether it was stored.
_ABSORB = f"""{WITH_SERVED}, {_CHECKED},
  likeness AS (SELECT a.vec_id AS x, b.vec_id AS y, {_SIM} AS similarity FROM embeddings a JOIN embeddings b ON {_SIM} >= 0.3),
  fit AS (SELECT l.*, (q.lang = '' OR e.lang = '' OR q.lang = e.lang) AND (len(q.qn) = 0 OR q.qn = e.en) AND (len(q.qt) = 0 OR q.qt = e.et) AS ok
    FROM likeness l JOIN g q ON q.id = CAST(l.x AS VARCHAR) JOIN g e ON e.id = CAST(l.y AS VARCHAR)),
  log AS (SELECT r.request_id, r.ts, r.doc_id, row_number() OVER (ORDER BY r.ts, r.request_id) AS n
    FROM req r JOIN served s USING (request_id) JOIN embeddings v ON v.vec_id = r.doc_id WHERE NOT s.l1_hit),
  near AS (SELECT q.n, list({{'m': e.n, 'ok': f.ok}} ORDER BY f.similarity DESC, e.n) AS near FROM log q
    JOIN log e ON e.n < q.n AND q.ts < e.ts + INTERVAL 1 DAY JOIN fit f ON f.x = q.doc_id AND f.y = e.doc_id GROUP BY q.n),
  turn AS (SELECT n, coalesce(near, []) AS near FROM log LEFT JOIN near USING (n)),
  walk(k, n, stored, hit) USING KEY (k) AS (SELECT 1, 0::BIGINT, []::BOOLEAN[], []::BIGINT[]
    UNION SELECT k, n, list_append(stored, h IS NULL), list_append(hit, h) FROM (SELECT w.k, t.n, w.stored, w.hit,
      list_filter(list_filter(t.near, lambda c: w.stored[c.m])[1:3], lambda c: c.ok)[1].m AS h FROM walk w JOIN turn t ON t.n = w.n + 1)),
  done AS (SELECT unnest(range(1, n + 1)) AS n, unnest(stored) AS stored, unnest(hit) AS hit FROM walk),
  outcome AS (SELECT s.request_id, coalesce(d.hit IS NOT NULL, false) AS l2_hit, e.request_id AS entry_id, round(f.similarity, 4) AS similarity,
    coalesce(d.stored, false) AS stored FROM served s LEFT JOIN log l USING (request_id) LEFT JOIN done d USING (n)
    LEFT JOIN log e ON e.n = d.hit LEFT JOIN fit f ON f.x = l.doc_id AND f.y = e.doc_id WHERE NOT s.l1_hit)
  SELECT request_id, l2_hit, entry_id, similarity, stored FROM outcome"""


@query("semantic_absorb", _ABSORB)
def _(s, d):
    r = _semantic_log(s, d)
    first = X.l1_attribute(r.select("request_id", "ts", "cache_key")).filter(~F.col("l1_hit")).select("request_id")
    found = semantic_absorb(r.join(first, "request_id", "left_semi"), _LONG.threshold, max_chars=_LONG.max_chars)
    return found.select("request_id", "l2_hit", "entry_id", F.round("similarity", 4).alias("similarity"), "stored")


@query("attribute_tiers")
def _(s, d):
    return attribute.attribute_tiers(_semantic_log(s, d), _LONG).select(
        "request_id", "tier", "entry_id", "quota_status", "cost_units", "saved_units")


@query("attribute_exact", WITH_SERVED + " SELECT request_id, tier, CAST(cost_units AS BIGINT) AS cost_units, CAST(saved_units AS BIGINT) AS saved_units FROM served")
def _(s, d):
    return served_log(s, d).select("request_id", "tier", "cost_units", "saved_units")


@query("cache_report", WITH_SERVED + """ SELECT tier, count(*) AS requests,
    CAST(sum(CASE WHEN tier = 'llm' THEN tokens_in ELSE 0 END) AS BIGINT) AS tokens_in,
    CAST(sum(CASE WHEN tier = 'llm' THEN tokens_out ELSE 0 END) AS BIGINT) AS tokens_out,
    sum(cost_units) / 1e8 AS cost_usd, sum(saved_units) / 1e8 AS saved_usd,
    round_even(count(*) * 100.0 / (SELECT count(*) FROM served), 1) AS share_pct FROM served GROUP BY tier""")
def _(s, d):
    return report.cache_report(served_log(s, d))


@query("diagnose_pairs", f"""WITH {_PAIRS}, st AS (SELECT t.vec_id, t.embedding FROM turned t WHERE t.vec_id IN (SELECT a FROM pairs)),
  near AS (SELECT a.vec_id AS a, count(*) AS n FROM st a JOIN st b ON a.vec_id <> b.vec_id WHERE {_SIM} >= 0.3 GROUP BY 1),
  sm AS (SELECT p.b AS q, b.vec_id AS sid, {_SIM} AS similarity FROM pairs p JOIN turned a ON a.vec_id = p.b JOIN st b ON true),
  rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, CAST(sid AS VARCHAR)) AS rank FROM sm),
  {_CHECKED},
  hit AS (SELECT rk.q, arg_min(sid, rank) AS entry FROM rk JOIN g x ON x.id = CAST(rk.q AS VARCHAR) JOIN g y ON y.id = CAST(rk.sid AS VARCHAR)
    WHERE rank <= 3 AND similarity >= 0.3 AND (x.lang = '' OR y.lang = '' OR x.lang = y.lang)
      AND (len(x.qn) = 0 OR x.qn = y.en) AND (len(x.qt) = 0 OR x.qt = y.et) GROUP BY rk.q)
  SELECT s.a, s.b, round_even(sb, 4) AS sim_before, round_even(sa, 4) AS sim_after, coalesce(n.n, 0) AS close_originals,
    h.entry IS NOT NULL AS hit, coalesce(h.entry = s.a, false) AS right_entry
  FROM sims s LEFT JOIN near n ON n.a = s.a LEFT JOIN hit h ON h.q = s.b""")
def _(s, d):
    pairs, raw, norm = _pairs(s, d)
    t = _vectors(s, d).select(F.col("vec_id").alias("id"), F.col("text").alias("query_text"), "lang")
    store = norm.join(pairs.select(F.col("a").alias("id")), "id", "left_semi").join(t, "id").select(
        F.col("id").cast("string").alias("entry_id"), "embedding", F.col("query_text").alias("content"), "lang",
        extract_keywords("query_text").alias("keywords"))
    return diagnose.diagnose_pairs(pairs, raw, norm, t, store, 0.3).select(
        "a", "b", "sim_before", "sim_after", "close_originals", "hit", "right_entry")


@query("compare_models", f"""WITH {_PAIRS}, m AS (SELECT 'first' AS model, sb, sa FROM sims UNION ALL SELECT 'second', sa, sa FROM sims)
  SELECT model, count(*) AS pairs, round_even(avg(round_even(sb, 4)), 4) AS mean_before, round_even(avg(round_even(sa, 4)), 4) AS mean_after,
    count(*) FILTER (sa >= 0.2) AS passing FROM m GROUP BY model""")
def _(s, d):
    pairs, raw, norm = _pairs(s, d)
    return diagnose.compare_models(pairs, {"first": (raw, norm), "second": (norm, norm)}, 0.2)


# --- language ---------------------------------------------------------------------------


_GRAMS = """chars AS (SELECT doc_id, lang, regexp_extract_all(text, '(?s).') AS c FROM documents),
  grams AS (SELECT doc_id, lang, unnest(list_concat(c, list_transform(range(1, len(c)), lambda i: c[i] || c[i+1]),
    list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2]))) AS gram FROM chars),
  counts AS (SELECT lang, gram, count(*) AS n FROM grams GROUP BY 1, 2),
  denom AS (SELECT lang, ln(sum(n) + (SELECT count(DISTINCT gram) FROM counts)) AS d FROM counts GROUP BY lang),
  prof AS (SELECT c.gram, c.lang, c.n, ln(c.n + 1) - d.d AS logp, -d.d AS floor FROM counts c JOIN denom d USING (lang))"""


@query("train_lang", f"WITH {_GRAMS} SELECT gram, lang, n, round(logp, 6) AS logp FROM prof")
def _(s, d):
    return language.train_lang(load_wide(s, d, "documents", "doc_id")).select("gram", "lang", "n", F.round("logp", 6).alias("logp"))


@query("score_lang", f"""WITH {_GRAMS}, dg AS (SELECT doc_id, gram, count(*) AS c FROM grams GROUP BY 1, 2),
  gain AS (SELECT doc_id, p.lang, sum(c * (logp - floor)) AS g FROM dg JOIN prof p USING (gram) GROUP BY 1, 2),
  tot AS (SELECT doc_id, sum(c) AS n FROM dg GROUP BY 1),
  sc AS (SELECT t.doc_id, dn.lang, coalesce(g, 0) - t.n * dn.d AS score FROM tot t JOIN denom dn ON true
    LEFT JOIN gain ON gain.doc_id = t.doc_id AND gain.lang = dn.lang)
  SELECT doc_id, arg_max(lang, score) AS lang FROM sc GROUP BY doc_id""")
def _(s, d):
    docs = load_wide(s, d, "documents", "doc_id")
    return language.score_lang(docs, language.train_lang(docs), "doc_id").select("doc_id", "lang")
