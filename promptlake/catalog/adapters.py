"""Readers, adapters and sinks. Input files are written by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.catalog.base import (
    CHAT, WITH_SERVED, answers, chat_requests, load, request_log, served_log,
    sql_keywords, us, with_vectors)
from promptlake.functions.text import query_text
from promptlake.session import new_run_dir
from promptlake.sources import files, logs, requests as R, responses, stores, workload

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _written(spark, name, df, column="value"):
    path = new_run_dir(spark, name)
    df.select(F.col(column).alias("value")).write.text(path)
    return path


def _chat_file(s, d, options: bool):
    """Chat requests as JSON lines. Some lack a user, some a model, some their messages, some break off."""
    c = chat_requests(s, d)
    shouting = F.transform("messages", lambda m: F.struct(F.upper(m["role"]).alias("role"), m["content"].alias("content")))
    fields = [
        "request_id",
        F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit("u"), "conv_id")).alias("user_id"),
        F.when(F.col("conv_id") % 2 > 0, F.lit("m1")).alias("model"),
        F.when(F.col("turn") > 2, F.lit(True)).alias("stream"),
        F.when(F.col("conv_id") % 7 > 0, shouting).alias("messages")]
    if options:
        fields.append(F.create_map(F.lit("turn"), F.col("turn").cast("string")).alias("options"))
    line = F.to_json(F.struct(*fields))
    line = F.when(F.col("conv_id") % 11 == 0, F.substring(line, F.lit(1), F.char_length(line) - 2)).otherwise(line)
    return _written(s, "requests", c.select(line.alias("value")))


def _summary(ok, bad, *extra):
    good = ok.select(
        "request_id", F.lit(True).alias("accepted"), "user_id", "model", "stream", "api",
        F.size("messages").alias("n_messages"), F.element_at("messages", -1)["role"].alias("last_role"),
        F.md5(query_text()).alias("text_md5"), *extra)
    return good.unionByName(bad.select(F.coalesce("request_id", F.lit("?")).alias("request_id"), F.lit(False).alias("accepted")),
                            allowMissingColumns=True)


def _chat_sql(api, extra=""):
    ok = "conv_id % 7 > 0 AND conv_id % 11 > 0"
    val = lambda e: f"CASE WHEN {ok} THEN {e} END"
    return f"""SELECT CASE WHEN conv_id % 11 = 0 THEN '?' ELSE request_id END AS request_id, {ok} AS accepted,
    {val("CASE WHEN conv_id % 3 > 0 THEN 'u' || conv_id ELSE 'anonymous' END")} AS user_id,
    {val("CASE WHEN conv_id % 2 > 0 THEN 'm1' ELSE 'qwen2.5:14b' END")} AS model,
    {val("turn > 2")} AS stream, {val(f"'{api}'")} AS api, {val("CAST(len(messages) AS INTEGER)")} AS n_messages,
    {val("'user'")} AS last_role, {val("md5(text)")} AS text_md5 {extra} FROM chat"""


# A record that breaks off may still show its first fields; only whether it is refused matters.
def _refused(bad):
    return bad.withColumn("request_id", F.when(F.col("_corrupt_record").isNull(), F.col("request_id")))


@query("read_requests", f"WITH {CHAT} {_chat_sql('openai')}")
def _(s, d):
    ok, bad = R.read_requests(s, _chat_file(s, d, False))
    return _summary(ok, _refused(bad))


@query("from_ollama_chat", f"""WITH {CHAT} {_chat_sql('ollama_chat', ", CASE WHEN conv_id % 7 > 0 AND conv_id % 11 > 0 THEN CAST(turn AS VARCHAR) END AS option")}""")
def _(s, d):
    ok, bad = R.read_requests(s, _chat_file(s, d, True), shape="ollama_chat")
    return _summary(ok, _refused(bad), F.col("options")["turn"].alias("option"))


def _generate_file(s, d):
    line = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("request_id"),
        F.when(F.col("doc_id") % 5 > 0, F.col("text")).alias("prompt"),
        F.when(F.col("doc_id") % 2 > 0, F.col("source")).alias("model")))
    return _written(s, "prompts", load(s, d, "documents").select(line.alias("value")))


_GENERATE = """SELECT CAST(doc_id AS VARCHAR) AS request_id, doc_id % 5 > 0 AS accepted,
    CASE WHEN doc_id % 5 > 0 THEN 'anonymous' END AS user_id,
    CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 > 0 THEN source ELSE 'qwen2.5:14b' END AS model,
    CASE WHEN doc_id % 5 > 0 THEN false END AS stream, CASE WHEN doc_id % 5 > 0 THEN 'ollama_generate' END AS api,
    CASE WHEN doc_id % 5 > 0 THEN 1 END AS n_messages, CASE WHEN doc_id % 5 > 0 THEN 'user' END AS last_role,
    CASE WHEN doc_id % 5 > 0 THEN md5(text) END AS text_md5 FROM documents"""


@query("from_ollama_generate", _GENERATE)
def _(s, d):
    return _summary(*R.read_requests(s, _generate_file(s, d), shape="ollama_generate"))


@query("unify_requests", f"""WITH {CHAT}, a AS ({_chat_sql('openai')} UNION ALL {_chat_sql('ollama_chat')} UNION ALL {_GENERATE})
  SELECT api, count(*) AS requests, count(DISTINCT user_id) AS users, CAST(sum(n_messages) AS BIGINT) AS messages,
    count(*) FILTER (api = 'ollama_chat') AS with_options FROM a WHERE accepted GROUP BY api""")
def _(s, d):
    all_ = R.unify_requests(
        R.read_requests(s, _chat_file(s, d, False))[0],
        R.read_requests(s, _chat_file(s, d, True), shape="ollama_chat")[0],
        R.read_requests(s, _generate_file(s, d), shape="ollama_generate")[0])
    return all_.groupBy("api").agg(
        F.count(F.lit(1)).alias("requests"), F.count_distinct("user_id").alias("users"),
        F.sum(F.size("messages").cast("bigint")).alias("messages"), F.count("options").alias("with_options"))


@query("read_gateway_events", WITH_SERVED + """ SELECT CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 THEN request_id END AS request_id,
    CAST(request_id AS BIGINT) % 97 > 0 AS readable,
    CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 THEN epoch_us(ts) // 1000 END AS ts_ms,
    CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 THEN CASE WHEN l1_hit THEN 'cache_hit' ELSE 'llm_call' END END AS event,
    CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 AND l1_hit THEN tier END AS tier,
    CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 THEN latency_ms END AS latency_ms,
    CASE WHEN CAST(request_id AS BIGINT) % 97 > 0 AND NOT l1_hit THEN CAST(tokens_in + tokens_out AS INTEGER) END AS tokens_used
  FROM served""")
def _(s, d):
    e = served_log(s, d)
    hit = F.col("l1_hit")
    body = F.to_json(F.struct(
        "request_id", F.when(hit, "cache_hit").otherwise("llm_call").alias("event"),
        F.when(hit, F.col("tier")).alias("tier"), "latency_ms", F.lit("m1").alias("model"), "user_id",
        F.when(~hit, F.col("tokens_in") + F.col("tokens_out")).alias("tokens_used")))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO gateway "), body)
    line = F.when(F.col("request_id").cast("bigint") % 97 == 0, F.substring(line, 1, 60)).otherwise(line)
    ok, bad = logs.read_gateway_events(s, _written(s, "gateway-log", e.select(line.alias("value"))))
    good = ok.select("request_id", F.lit(True).alias("readable"), F.unix_millis("ts").alias("ts_ms"), "event", "tier",
                     "latency_ms", "tokens_used")
    return good.unionByName(bad.select(F.lit(False).alias("readable")), allowMissingColumns=True)


def _array_files(s, name, df, group):
    """JSON arrays, one per file, each of bounded length."""
    arrays = df.groupBy(group.alias("_g")).agg(F.collect_list(F.struct(*df.columns)).alias("_a"))
    path = new_run_dir(s, name)
    arrays.select(F.to_json("_a").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("read_eval_pairs", """SELECT CAST(a.vec_id AS VARCHAR) AS original, CAST(b.vec_id AS VARCHAR) AS paraphrase,
    a.label = b.label AS expected_hit, CAST(a.label AS VARCHAR) AS category
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _(s, d):
    e = load(s, d, "embeddings").select("vec_id", "label")
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2")), "vec_id").select(
        F.col("vec_id").cast("string").alias("original"), (F.col("vec_id") + 1).cast("string").alias("paraphrase"),
        (F.col("label") == F.col("l2")).alias("expected_hit"), F.col("label").cast("string").alias("category"))
    return files.read_eval_pairs(s, _array_files(s, "pairs", p, F.floor(F.col("original").cast("bigint") / 100)))


_WORKLOAD = """SELECT CAST(CASE WHEN r = 0 THEN doc_id ELSE doc_id + (SELECT count(*) FROM documents) END AS BIGINT) AS idx,
    source AS question, r > 0 AS is_duplicate, doc_id AS original_idx, CAST(r AS INTEGER) AS round
  FROM documents, range(0, 3) t(r)"""


def _workload(s, d):
    q = load(s, d, "documents").select(F.col("doc_id").alias("idx"), F.col("source").alias("question"))
    return workload.build_workload(q, repeats=3)


@query("build_workload", _WORKLOAD)
def _(s, d):
    return _workload(s, d).drop("order_key")


@query("read_workload", f"""SELECT CAST(idx AS INTEGER) AS idx, question, is_duplicate, CAST(original_idx AS INTEGER) AS original_idx
  FROM ({_WORKLOAD})""")
def _(s, d):
    w = _workload(s, d).drop("round", "order_key")
    return files.read_workload(s, _array_files(s, "workload", w, F.floor(F.col("original_idx") / 50)))


@query("read_results", WITH_SERVED + """ SELECT CAST(request_id AS INTEGER) AS idx, l1_hit AS cached, latency_ms,
    CASE WHEN CAST(request_id AS BIGINT) % 101 = 0 THEN 'timeout' END AS error FROM served""")
def _(s, d):
    e = served_log(s, d).select(
        F.col("request_id").cast("int").alias("idx"), F.col("l1_hit").alias("cached"), "latency_ms",
        F.when(F.col("request_id").cast("bigint") % 101 == 0, F.lit("timeout")).alias("error"))
    r = files.read_results(s, _array_files(s, "results", e, F.floor(F.col("idx") / 200)))
    return r.select("idx", "cached", "latency_ms", "error")


@query("write_report", """SELECT user_id, count(*) AS requests, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def _(s, d):
    r = load(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("value"), 4).alias("total"))
    path = new_run_dir(s, "report")
    files.write_report(r, path)
    return s.read.schema(r.schema).json(path)


@query("l1_store_build", WITH_SERVED + """ SELECT cache_key, arg_max(request_id, ts) AS content, epoch_us(max(ts)) AS stored_at_us,
    epoch_us(max(ts)) + 86400000000 AS expires_at_us FROM served WHERE NOT l1_hit GROUP BY cache_key""")
def _(s, d):
    w = served_log(s, d).filter(~F.col("l1_hit")).withColumn("content", F.col("request_id"))
    st = stores.l1_store_build(w)
    return st.select("cache_key", "content", us("stored_at"), us("expires_at"))


@query("l2_store_build", f"""SELECT CAST(e.event_id AS VARCHAR) AS entry_id, d.lang, array_to_string({sql_keywords('d.text')}, ',') AS keywords,
    v.embedding[1] AS first_value, epoch_us(e.ts) + 3600000000 AS expires_at_us
  FROM events e JOIN documents d ON d.doc_id = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
  JOIN embeddings v ON v.vec_id = d.doc_id WHERE length(d.text) <= 2000""")
def _(s, d):
    r = with_vectors(request_log(s, d, True), s, d).withColumns({"content": F.col("request_id"), "model": F.lit("m1")})
    st = stores.l2_store_build(r, ttl_s=3600, max_chars=2000)
    return st.select("entry_id", "lang", F.array_join("keywords", ",").alias("keywords"),
                     F.col("embedding")[0].alias("first_value"), us("expires_at"))


def _lines(s, d):
    """Documents as captured streams: one event per line of text, with noise in between."""
    t = load(s, d, "documents").select(
        F.col("doc_id").alias("response_id"), F.posexplode(F.split("text", "\n")).alias("seq", "part"))
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("part").alias("content"), (F.col("seq") == 3).alias("done"))))
    line = (F.when(F.col("seq") % 7 == 5, F.lit(": keep-alive"))
            .when(F.col("seq") % 7 == 6, F.lit('data: {"content": "brok'))
            .when(F.col("seq") % 7 == 4, F.lit('data: {}')).otherwise(event))
    return t.select("response_id", "seq", line.alias("line"))


@query("parse_stream_capture", """WITH p AS (SELECT doc_id AS response_id, unnest(string_split(text, chr(10))) AS part,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents)
  SELECT response_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq % 7 = 4 THEN '' ELSE part END AS delta, seq = 3 AS done
  FROM p WHERE seq % 7 NOT IN (5, 6)""")
def _(s, d):
    return logs.parse_stream_capture(_lines(s, d)).select("response_id", "seq", "delta", "done")


def _responses(s, d):
    a = answers(s, d).withColumn("content", F.coalesce("content", F.lit("")))
    return a.select(
        "request_id", "content", F.lit("m1").alias("model"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id")).alias("ts"),
        F.when(F.col("turn") > 1, F.col("turn").cast("int")).alias("tokens_used"))


_RESPONSES = f"""{CHAT}, resp AS (SELECT c.request_id, c.conv_id, c.turn, coalesce(a.text, '') AS content
  FROM chat c LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 AND a.role = 'assistant')"""


def _fields(df, col, **paths):
    return df.select("request_id", *[F.get_json_object(col, p).alias(n) for n, p in paths.items()])


@query("to_ollama_chat", f"""WITH {_RESPONSES} SELECT request_id, 'm1' AS model, 'assistant' AS role, content AS content, 'true' AS done,
    '0' AS total_duration, '0' AS prompt_eval_count, CAST(CASE WHEN turn > 1 THEN turn ELSE 0 END AS VARCHAR) AS eval_count,
    strftime(make_timestamp((1704067200 + conv_id) * 1000000), '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at FROM resp""")
def _(s, d):
    return _fields(
        responses.to_ollama_chat(_responses(s, d)), "body", model="$.model", role="$.message.role", content="$.message.content",
        done="$.done", total_duration="$.total_duration", prompt_eval_count="$.prompt_eval_count", eval_count="$.eval_count",
        created_at="$.created_at")


@query("to_ollama_generate", f"""WITH {_RESPONSES} SELECT request_id, content AS response, 'true' AS done,
    CAST(CASE WHEN turn > 1 THEN turn ELSE 0 END AS VARCHAR) AS eval_count FROM resp""")
def _(s, d):
    return _fields(responses.to_ollama_generate(_responses(s, d)), "body", response="$.response", done="$.done", eval_count="$.eval_count")


_CHUNKS = "SELECT request_id, 0 AS seq, content AS delta, false AS done, CAST(NULL AS BOOLEAN) AS truncated FROM resp UNION ALL SELECT request_id, 1, '', true, false FROM resp"


@query("to_chunks", f"WITH {_RESPONSES} {_CHUNKS}")
def _(s, d):
    return responses.to_chunks(_responses(s, d)).select("request_id", "seq", "delta", "done", "truncated")


@query("to_ndjson", f"""WITH {_RESPONSES}, ch AS ({_CHUNKS}) SELECT request_id, 'chat' AS api, delta AS content, CAST(done AS VARCHAR) AS done,
    CASE WHEN done THEN '0' END AS total_duration FROM ch
  UNION ALL SELECT request_id, 'generate', delta, CAST(done AS VARCHAR), NULL FROM ch""")
def _(s, d):
    c = responses.to_chunks(_responses(s, d))
    chat = _fields(responses.to_ndjson(c), "line", content="$.message.content", done="$.done", total_duration="$.total_duration")
    gen = _fields(responses.to_ndjson(c, "generate"), "line", content="$.response", done="$.done", total_duration="$.total_duration")
    return chat.withColumn("api", F.lit("chat")).unionByName(gen.withColumn("api", F.lit("generate")))
