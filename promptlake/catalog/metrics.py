"""Counters, histograms, rates, queue series and load samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from promptlake.catalog.base import RULES, WITH_SERVED, events, quoted, request_log, served_log, us
from promptlake.operators import load as L, metrics as M, queue as Q
from promptlake.rules import LATENCY_BUCKETS
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


def served(name, sql, build):
    QUERIES[name] = lambda s, d: build(served_log(s, d))
    ORACLES[name] = WITH_SERVED + sql


served("hits_by_tier", "SELECT tier, count(*) AS hits FROM served WHERE l1_hit GROUP BY tier", M.hits_by_tier)
served("llm_calls", "SELECT count(*) FILTER (NOT l1_hit) AS calls FROM served", M.llm_calls)
served("total_cost", "SELECT sum(cost_units) / 1e8 AS cost_usd FROM served", M.total_cost)
served("saved_by_tier", "SELECT tier, sum(saved_units) / 1e8 AS saved_usd FROM served WHERE l1_hit GROUP BY tier", M.saved_by_tier)
served("tokens_by_type", """SELECT 'input' AS type, CAST(sum(tokens_in) AS BIGINT) AS tokens FROM served WHERE NOT l1_hit
  UNION ALL SELECT 'output', CAST(sum(tokens_out) AS BIGINT) FROM served WHERE NOT l1_hit""", M.tokens_by_type)

_STATUS = "CASE WHEN l1_hit THEN 'hit' ELSE 'miss' END"
_BOUNDS = "bounds(le, x) AS (VALUES " + ", ".join(f"('{float(b)}', {float(b)}::DOUBLE)" for b in LATENCY_BUCKETS) + ", ('+Inf', 1e300))"
_HIST = f"""{_BOUNDS}, hist AS (SELECT {_STATUS} AS cache_status, le, x, count(*) FILTER (latency_ms / 1000 <= x) AS cum, count(*) AS n,
  round(sum(latency_ms / 1000), 6) AS sum_s FROM served, bounds GROUP BY ALL)"""


def _quantile_sql(keys):
    """Quantiles from ``hist``: linear inside the bucket, last finite bound beyond it."""
    cols = []
    for name, q in M.QUANTILES.items():
        cols.append(f"""min(CASE WHEN cum >= {q} * n AND lo_cum < {q} * n THEN
          CASE WHEN le = '+Inf' THEN lo ELSE lo + (x - lo) * ({q} * n - lo_cum) / (cum - lo_cum) END END) AS {name}""")
    w = f"PARTITION BY {keys} ORDER BY x"
    return f"""w AS (SELECT *, coalesce(lag(x) OVER ({w}), 0) AS lo, coalesce(lag(cum) OVER ({w}), 0) AS lo_cum FROM hist)
      SELECT {keys}, {', '.join(f'round({c.rsplit(" AS ", 1)[0]}, 9) AS {c.rsplit(" AS ", 1)[1]}' for c in cols)} FROM w GROUP BY {keys}"""


def _rounded(df, *cols, places=9):
    return df.withColumns({c: F.round(c, places) for c in cols})


served("latency_histogram", f", {_HIST} SELECT cache_status, le, cum, n, sum_s FROM hist",
       lambda e: _rounded(M.latency_histogram(e), "sum_s", places=6))
served("histogram_quantile", f", {_HIST}, {_quantile_sql('cache_status')}",
       lambda e: _rounded(M.histogram_quantile(M.latency_histogram(e)), "p50", "p95", "p99"))
served("latency_percentiles", f"""SELECT {_STATUS} AS cache_status, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
    round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99 FROM served GROUP BY 1""",
       lambda e: _rounded(M.latency_percentiles(e), "p50", "p95", "p99", places=6))

_LEVEL = "CASE WHEN hit_ratio < 0.3 THEN 'red' WHEN hit_ratio < 0.5 THEN 'yellow' WHEN hit_ratio IS NOT NULL THEN 'green' END AS level"
served("hit_ratio", f""", h AS (SELECT count(*) FILTER (l1_hit) AS hits, count(*) FILTER (NOT l1_hit) AS calls,
    count(*) FILTER (l1_hit) / count(*) AS hit_ratio FROM served) SELECT *, {_LEVEL} FROM h""", M.hit_ratio)
served("hit_ratio_by_user", f""", h AS (SELECT user_id, count(*) FILTER (l1_hit) AS hits, count(*) FILTER (NOT l1_hit) AS calls,
    count(*) FILTER (l1_hit) / count(*) AS hit_ratio FROM served GROUP BY user_id) SELECT *, {_LEVEL} FROM h""",
       lambda e: M.hit_ratio(e, ["user_id"]))
served("cost_share", """, t AS (SELECT sum(cost_units) AS c, sum(saved_units) AS s FROM served)
  SELECT c / 1e8 AS cost_usd, s / 1e8 AS saved_usd, round_even(c * 100.0 / (c + s), 1) AS cost_pct, round_even(s * 100.0 / (c + s), 1) AS saved_pct FROM t""",
       M.cost_share)
served("metrics_snapshot", f""", {_HIST}
  SELECT 'cache_hits_total' AS metric, 'l1_hash' AS label, count(*)::DOUBLE AS value FROM served WHERE l1_hit
  UNION ALL SELECT 'cost_saved_usd', 'l1_hash', sum(saved_units) / 1e8 FROM served
  UNION ALL SELECT 'api_calls_total', '', count(*)::DOUBLE FROM served WHERE NOT l1_hit
  UNION ALL SELECT 'total_cost_usd', '', sum(cost_units) / 1e8 FROM served
  UNION ALL SELECT 'tokens_total', 'input', sum(tokens_in)::DOUBLE FROM served WHERE NOT l1_hit
  UNION ALL SELECT 'tokens_total', 'output', sum(tokens_out)::DOUBLE FROM served WHERE NOT l1_hit
  UNION ALL SELECT 'latency_seconds_bucket', cache_status || ',' || le, cum::DOUBLE FROM hist
  UNION ALL SELECT 'latency_seconds_count', cache_status, n::DOUBLE FROM hist WHERE le = '+Inf'
  UNION ALL SELECT 'latency_seconds_sum', cache_status, sum_s FROM hist WHERE le = '+Inf'""",
       lambda e: M.metrics_snapshot(e).select(
           "metric", F.array_join(F.map_values("labels"), ",").alias("label"), F.round("value", 6).alias("value")))

_STEPS = """steps AS (SELECT *, CAST(ceil(epoch_us(ts) / 15000000.0) AS BIGINT) AS g FROM served),
  spread AS (SELECT *, unnest(range(g, g + 20)) AS t FROM steps)"""
served("rate_5m", f""", {_STEPS}, r AS (SELECT t * 15000000 AS ts_us, count(*) FILTER (l1_hit) / 300 AS hits_per_s,
    count(*) FILTER (NOT l1_hit) / 300 AS calls_per_s, count(*) FILTER (l1_hit) / count(*) AS hit_ratio FROM spread GROUP BY t)
  SELECT ts_us, round(hits_per_s, 9) AS hits_per_s, round(calls_per_s, 9) AS calls_per_s, round(hit_ratio, 9) AS hit_ratio, {_LEVEL} FROM r""",
       lambda e: _rounded(M.rate_5m(e), "hits_per_s", "calls_per_s", "hit_ratio").select(
           us("ts"), "hits_per_s", "calls_per_s", "hit_ratio", "level"))
served("latency_quantiles_5m", f""", {_STEPS}, {_BOUNDS}, hist AS (SELECT {_STATUS} AS cache_status, t * 15000000 AS ts_us, le, x,
    count(*) FILTER (latency_ms / 1000 <= x) AS cum, count(*) AS n FROM spread, bounds GROUP BY ALL), {_quantile_sql('cache_status, ts_us')}""",
       lambda e: _rounded(M.latency_quantiles_5m(e), "p50", "p95", "p99").select("cache_status", us("ts"), "p50", "p95", "p99"))
_CUM = """, m AS (SELECT date_trunc('minute', ts) AS ts, sum(cost_units) AS c, sum(saved_units) AS s FROM served GROUP BY 1),
  cum AS (SELECT epoch_us(ts) AS ts_us, sum(c) OVER (ORDER BY ts) / 1e8 AS cost_usd, sum(s) OVER (ORDER BY ts) / 1e8 AS saved_usd FROM m)"""
served("cumulative_cost", f"{_CUM} SELECT * FROM cum",
       lambda e: M.cumulative_cost(e).select(us("ts"), "cost_usd", "saved_usd"))
served("series_summary", f"""{_CUM}, l AS (SELECT 'cost_usd' AS metric, ts_us, cost_usd AS value FROM cum
    UNION ALL SELECT 'saved_usd', ts_us, saved_usd FROM cum)
  SELECT metric, arg_max(value, ts_us) AS last, max(value) AS max, round(avg(value), 6) AS mean FROM l GROUP BY metric""",
       lambda e: _rounded(M.series_summary(M.cumulative_cost(e).select(
           "ts", F.expr("stack(2, 'cost_usd', cost_usd, 'saved_usd', saved_usd) as (metric, value)"))), "mean", places=6))
served("duplicate_share", """SELECT count(*) AS requests, count(DISTINCT cache_key) AS distinct_prompts,
    round_even((count(*) - count(DISTINCT cache_key)) * 100.0 / count(*), 1) AS duplicate_pct FROM served""", M.duplicate_share)
QUERIES["duplicate_share_approx"] = lambda s, d: M.duplicate_share_approx(request_log(s, d))


# --- queue ------------------------------------------------------------------------------


def _calls(s, d):
    """A model call per event: it enters at ``ts`` and leaves ``value`` seconds later."""
    return events(s, d).select(
        F.concat(F.lit("pod-"), F.col("user_id") % 3).alias("pod"), F.col("ts").alias("enter_ts"),
        F.timestamp_micros(F.unix_micros("ts") + F.round(F.col("value") * 1e6).cast("bigint")).alias("exit_ts"))


_DEPTH = """calls AS (SELECT 'pod-' || user_id % 3 AS pod, epoch_us(ts) AS a, epoch_us(ts) + CAST(round(value * 1000000) AS BIGINT) AS b FROM events),
  marks AS (SELECT pod, a AS t, 1 AS d FROM calls UNION ALL SELECT pod, b, -1 FROM calls),
  net AS (SELECT pod, t, sum(d) AS d FROM marks GROUP BY 1, 2),
  raw AS (SELECT pod, t, sum(d) OVER (PARTITION BY pod ORDER BY t) AS s FROM net),
  held AS (SELECT pod, t, CAST(ceil(t / 5000000.0) AS BIGINT) AS g, s - least(0, min(s) OVER (PARTITION BY pod ORDER BY t)) AS s FROM raw),
  ends AS (SELECT pod, g, arg_max(s, t) AS s FROM held GROUP BY 1, 2),
  grid AS (SELECT pod, unnest(range(min(g), max(g) + 1)) AS g FROM ends GROUP BY pod),
  depth AS (SELECT grid.pod, grid.g, CAST(last_value(s IGNORE NULLS) OVER (PARTITION BY grid.pod ORDER BY grid.g) AS BIGINT) AS depth
    FROM grid LEFT JOIN ends ON ends.pod = grid.pod AND ends.g = grid.g)"""
_AVG = _DEPTH + """, av AS (SELECT *, avg(depth) OVER (PARTITION BY pod ORDER BY g ROWS 11 PRECEDING) AS avg_1m,
    avg(depth) OVER (PARTITION BY pod ORDER BY g ROWS 59 PRECEDING) AS avg_5m FROM depth)"""


@query("queue_depth", f"""WITH {_DEPTH} SELECT pod, g // 720 AS hour, count(*) AS samples, max(depth) AS most,
    CAST(sum(depth) AS BIGINT) AS total, max(CASE WHEN depth > 0 THEN g * 5000000 END) AS last_busy_us FROM depth GROUP BY 1, 2""")
def _(s, d):
    """The series has a row every five seconds of the month; printed per hour."""
    t = F.unix_micros("ts")
    return Q.queue_depth(_calls(s, d)).groupBy("pod", F.expr("unix_micros(ts) div 3600000000").alias("hour")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("depth").alias("most"), F.sum("depth").alias("total"),
        F.max(F.when(F.col("depth") > 0, t)).alias("last_busy_us"))


@query("moving_avg", f"WITH {_AVG} SELECT pod, count(*) AS samples, max(avg_1m) AS max_1m, max(avg_5m) AS max_5m, round(sum(avg_1m), 3) AS sum_1m, round(sum(avg_5m), 3) AS sum_5m FROM av GROUP BY pod")
def _(s, d):
    a = Q.moving_avg(Q.queue_depth(_calls(s, d)), step_s=5)
    return a.groupBy("pod").agg(
        F.count(F.lit(1)).alias("samples"), F.max("avg_1m").alias("max_1m"), F.max("avg_5m").alias("max_5m"),
        F.round(F.sum("avg_1m"), 3).alias("sum_1m"), F.round(F.sum("avg_5m"), 3).alias("sum_5m"))


@query("moving_avg_numbered", f"WITH {_AVG} SELECT pod, count(*) AS samples, max(avg_1m) AS max_1m, max(avg_5m) AS max_5m FROM av GROUP BY pod")
def _(s, d):
    """The path for samples without a fixed step."""
    a = Q.moving_avg(Q.queue_depth(_calls(s, d)))
    return a.groupBy("pod").agg(
        F.count(F.lit(1)).alias("samples"), F.max("avg_1m").alias("max_1m"), F.max("avg_5m").alias("max_5m"))


@query("breach_flags", f"""WITH {_AVG}, f AS (SELECT pod, CASE WHEN avg_1m > 3 THEN 'up' WHEN avg_5m < 1 THEN 'down' ELSE 'hold' END AS action FROM av)
  SELECT pod, action, count(*) AS samples FROM f GROUP BY 1, 2""")
def _(s, d):
    f = Q.breach_flags(Q.moving_avg(Q.queue_depth(_calls(s, d)), step_s=5), up=3, down=1)
    return f.groupBy("pod", "action").agg(F.count(F.lit(1)).alias("samples"))


@query("across_pods", f"""WITH {_AVG}, x AS (SELECT g, sum(depth) AS depth, avg(avg_1m) AS a1, avg(avg_5m) AS a5 FROM av GROUP BY g)
  SELECT CAST(depth AS BIGINT) AS depth, count(*) AS samples, round(max(a1), 6) AS max_1m, round(max(a5), 6) AS max_5m FROM x GROUP BY depth""")
def _(s, d):
    a = Q.across_pods(Q.moving_avg(Q.queue_depth(_calls(s, d)), step_s=5))
    return a.groupBy("depth").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("avg_1m"), 6).alias("max_1m"),
                                  F.round(F.max("avg_5m"), 6).alias("max_5m"))


_AT = 1705276800  # the middle of the month


@query("status_snapshot", WITH_SERVED + f""", st AS (SELECT max(ts) AS a, max(ts) + INTERVAL 1 DAY AS b FROM served WHERE NOT l1_hit GROUP BY cache_key),
  e AS (SELECT ts AS a, ts + INTERVAL 1 HOUR AS b FROM req WHERE length(text) <= 2000 AND doc_id IN (SELECT vec_id FROM embeddings)),
  {_AVG}, last AS (SELECT pod, arg_max(depth, g) AS d, arg_max(avg_1m, g) AS a1, arg_max(avg_5m, g) AS a5 FROM av WHERE g * 5 <= {_AT} GROUP BY pod),
  now AS (SELECT make_timestamp({_AT}000000) AS t)
  SELECT 'l1_entries' AS item, count(*)::DOUBLE AS value FROM st, now WHERE a <= t AND t < b
  UNION ALL SELECT 'l2_entries', count(*)::DOUBLE FROM e, now WHERE a <= t AND t < b
  UNION ALL SELECT 'current_depth', sum(d)::DOUBLE FROM last UNION ALL SELECT 'avg_1m', round_even(avg(a1), 2) FROM last
  UNION ALL SELECT 'avg_5m', round_even(avg(a5), 2) FROM last UNION ALL SELECT 'quota_limit', 100000.0""")
def _(s, d):
    from promptlake.catalog.base import with_vectors
    l1 = stores.l1_store_build(served_log(s, d).filter(~F.col("l1_hit")).withColumn("content", F.col("request_id")))
    l2 = stores.l2_store_build(
        with_vectors(request_log(s, d, True), s, d).withColumns({"content": F.lit(""), "model": F.lit("m1")}),
        ttl_s=3600, max_chars=2000)
    a = Q.moving_avg(Q.queue_depth(_calls(s, d)), step_s=5)
    return M.status_snapshot(l1, l2, a, 100_000, F.timestamp_seconds(F.lit(_AT)))


# --- load samples -----------------------------------------------------------------------


def _samples(s, d):
    """Events as load-test samples: an hour of each scenario, every status, two endpoints."""
    i = F.col("event_id")
    return events(s, d).select(
        F.element_at(F.array(*[F.lit(x) for x in ("baseline", "ramp", "spike", "soak")]), (i % 4 + 1).cast("int")).alias("scenario"),
        F.timestamp_micros(F.lit(1704067200000000) + F.pmod(F.unix_micros("ts") * 7, F.lit(4000000000))).alias("ts"),
        F.when(i % 53 == 0, 503).when(i % 29 == 0, 429).otherwise(200).alias("status"),
        (F.col("value") * 11).alias("duration_ms"), (F.col("user_id") % 2 == 0).alias("cached"),
        F.when(i % 3 == 0, "ollama_chat").otherwise("openai").alias("api"))


_SAMPLES = """samples AS (SELECT (['baseline', 'ramp', 'spike', 'soak'])[event_id % 4 + 1] AS scenario,
    (epoch_us(ts) * 7) % 4000000000 AS us, CASE WHEN event_id % 53 = 0 THEN 503 WHEN event_id % 29 = 0 THEN 429 ELSE 200 END AS status,
    value * 11 AS duration_ms, user_id % 2 = 0 AS cached, CASE WHEN event_id % 3 = 0 THEN 'ollama_chat' ELSE 'openai' END AS api FROM events)"""


@query("load_rates", f"""WITH {_SAMPLES} SELECT scenario, count(*) AS n, round(avg((status >= 400)::INT), 9) AS error_rate,
    round(avg(cached::INT) FILTER (status = 200), 9) AS cache_hit_rate, round(avg((NOT cached)::INT) FILTER (status = 200), 9) AS llm_call_rate,
    round(avg((status = 429)::INT), 9) AS quota_exceeded_rate, round(avg((status >= 500)::INT), 9) AS server_error_rate,
    round(avg((status IN (200, 429))::INT), 9) AS ok_or_quota_rate FROM samples GROUP BY scenario""")
def _(s, d):
    r = L.load_rates(_samples(s, d))
    return _rounded(r, *[c for c in r.columns if c.endswith("_rate")])


_SLO = "slo(scenario, metric, op, bound) AS (VALUES " + ", ".join(
    f"({quoted(a)}, {quoted(b)}, {quoted(c)}, {x}::DOUBLE)" for a, b, c, x in RULES.slo) + ")"


@query("slo_check", f"""WITH {_SAMPLES}, {_SLO}, m AS (
    SELECT scenario, 'error_rate' AS metric, avg((status >= 400)::INT) AS value FROM samples GROUP BY 1
    UNION ALL SELECT scenario, 'server_error_rate', avg((status >= 500)::INT) FROM samples GROUP BY 1
    UNION ALL SELECT scenario, 'p95_ms', quantile_cont(duration_ms, 0.95) FROM samples GROUP BY 1
    UNION ALL SELECT scenario, 'p99_ms', quantile_cont(duration_ms, 0.99) FROM samples GROUP BY 1
    UNION ALL SELECT scenario, 'compat_p95_ms', quantile_cont(duration_ms, 0.95) FROM samples WHERE api = 'ollama_chat' GROUP BY 1)
  SELECT scenario, metric, round(value, 6) AS value, op, bound, value < bound AS met FROM m JOIN slo USING (scenario, metric)""")
def _(s, d):
    return _rounded(L.slo_check(_samples(s, d)), "value", places=6)


_STAGES = "stages(scenario, stage, start_s, end_s, target) AS (VALUES " + ", ".join(
    f"({quoted(a)}, {b}, {c}, {x}, {y})" for a, b, c, x, y in RULES.stages) + ")"


@query("by_stage", f"""WITH {_SAMPLES}, {_STAGES}, o AS (SELECT *, (us - min(us) OVER (PARTITION BY scenario)) / 1e6 AS off FROM samples)
  SELECT o.scenario, coalesce(st.stage, 0) AS stage, max(target) AS target, round(avg((status >= 400)::INT), 9) AS error_rate,
    round(avg(duration_ms), 6) AS mean_ms, count(*) AS n, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms
  FROM o LEFT JOIN stages st ON st.scenario = o.scenario AND off >= start_s AND off < end_s GROUP BY 1, 2""")
def _(s, d):
    return _rounded(_rounded(L.by_stage(_samples(s, d)), "error_rate"), "mean_ms", "p95_ms", places=6)


@query("by_endpoint", f"""WITH {_SAMPLES} SELECT api, status, count(*) AS n, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
    round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM samples GROUP BY 1, 2""")
def _(s, d):
    return _rounded(L.by_endpoint(_samples(s, d)), "p50_ms", "p95_ms", places=6)


@query("project_monthly_cost", WITH_SERVED + """, p AS (SELECT user_id, count(*) / 30.0 AS per_day, avg(l1_hit::INT) AS hr, avg(tokens_in) AS ti, avg(tokens_out) AS tou FROM served GROUP BY 1),
  c AS (SELECT user_id, per_day * 30 * (ti * 0.01 + tou * 0.03) / 1000 AS a, per_day * 30 * (1 - hr) * (ti * 0.01 + tou * 0.9 * 0.03) / 1000 AS b FROM p)
  SELECT user_id, round(a, 6) AS cost_without, round(b, 6) AS cost_with, round(a - b, 6) AS saving, round((a - b) * 100 / a, 1) AS saving_pct FROM c""")
def _(s, d):
    p = served_log(s, d).groupBy("user_id").agg(
        (F.count(F.lit(1)) / 30.0).alias("requests_per_day"), F.avg(F.col("l1_hit").cast("int")).alias("hit_ratio"),
        F.avg("tokens_in").alias("tokens_in"), F.avg("tokens_out").alias("tokens_out")).withColumns({
            "cached_tokens_out": F.col("tokens_out") * 0.9, "price_in_1k": F.lit(0.01), "price_out_1k": F.lit(0.03)})
    return _rounded(L.project_monthly_cost(p), "cost_without", "cost_with", "saving", places=6).select(
        "user_id", "cost_without", "cost_with", "saving", "saving_pct")
