"""Streams over files that Spark writes from the given tables, in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.catalog.base import WITH_SERVED, events, request_log, served_log, us
from promptlake.catalog.caching import ORACLES as BATCH_SQL, _LONG, _semantic_log, chunks
from promptlake.catalog.metrics import _AVG, _calls
from promptlake.operators import exact_cache as X, queue as Q
from promptlake.session import cut, new_run_dir
from promptlake.streaming import batches, ordered, windows

QUERIES: dict = {}
ORACLES: dict = {}
SLICES = 3


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def _slices(spark, df: DataFrame, slice_of, path: str, heartbeat: bool = False):
    """Write ``df`` slice by slice, pausing after each one for the stream to take it as a batch. A
    last row far in the future lets the watermark pass everything before it; it is dropped from
    the results. The rows are stored first, or every slice would work them all out again."""
    sliced = cut(df.withColumn("_slice", slice_of))
    for i in range(SLICES):
        sliced.filter(F.col("_slice") == i).drop("_slice").write.mode("append").parquet(path)
        yield i
    if heartbeat:
        blank = [F.timestamp_seconds(F.lit(4102444800)).alias("ts") if f.name == "ts" else
                 F.lit("heartbeat").cast(f.dataType).alias(f.name) if f.dataType.simpleString() == "string" else
                 F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        spark.range(1).select(*blank).write.mode("append").parquet(path)
        yield SLICES


def _month_slice():
    """Thirds of January 2024 by time; earlier rows and those without a time come first."""
    third = F.floor((F.unix_timestamp("ts") - 1704067200) / 864000)
    return F.greatest(F.lit(0), F.least(F.lit(SLICES - 1), F.coalesce(third, F.lit(0)))).cast("int")


def _run(spark, df: DataFrame, slice_of, operator, heartbeat: bool = True) -> DataFrame:
    """``operator`` over ``df`` as a stream of slices. Every slice is a batch of its own, taken by
    a new start of the same stream, so state is carried over batches and restarts.

    State is cut into as many parts as there are shuffle partitions, and every part costs time in
    every batch: on one machine, one part per core is enough."""
    run, path = new_run_dir(spark, "stream"), new_run_dir(spark, "slices")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", min(int(parts), spark.sparkContext.defaultParallelism))
    try:
        for _ in _slices(spark, df, slice_of, path, heartbeat):
            stream = operator(spark.readStream.schema(df.schema).parquet(path))
            batches.run_available(stream, f"{run}/out", f"{run}/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


@query("stream_l1", BATCH_SQL["l1_attribute"])
def _(s, d):
    r = request_log(s, d).select("request_id", "ts", "cache_key")
    out = _run(s, r, _month_slice(), ordered.stream_l1)
    return out.filter("request_id <> 'heartbeat'").select("request_id", "l1_hit", F.col("anchor_us").alias("anchor_ts_us"))


@query("stream_quota", "SELECT request_id, admitted, used_before, status FROM (" + BATCH_SQL["quota_gate"] + ")")
def _(s, d):
    m = served_log(s, d).filter(~F.col("l1_hit")).select(
        "request_id", "user_id", "ts", (F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))
    beat = F.coalesce("tokens", F.lit(0)).alias("tokens")
    out = _run(s, m, _month_slice(), lambda r: ordered.stream_quota(r.select("request_id", "user_id", "ts", beat), 5000))
    return out.filter("request_id <> 'heartbeat'").select("request_id", "admitted", "used_before", "status")


@query("stream_truncate", BATCH_SQL["truncate_stream"])
def _(s, d):
    c = chunks(s, d).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("seq")))
    # the first lines of every response come first, but neighbours change places across slices
    place = F.col("seq").bitwiseXOR(F.lit(1))
    slice_ = F.when(place < 3, 0).when(place < 6, 1).otherwise(2)
    return _run(s, c, slice_, ordered.stream_truncate, heartbeat=False)


@query("stream_queue_avg", f"""WITH {_AVG} SELECT pod, g // 17280 AS day, count(*) AS samples, max(avg_1m) AS max_1m,
    max(avg_5m) AS max_5m, round(sum(avg_1m), 3) AS sum_1m, round(sum(avg_5m), 3) AS sum_5m FROM av GROUP BY 1, 2""")
def _(s, d):
    """Every sample of the five-second grid goes through the stream; printed per pod and day."""
    q = Q.queue_depth(_calls(s, d)).select("pod", "ts", "depth")
    beat = F.coalesce("depth", F.lit(0)).alias("depth")
    out = _run(s, q, _month_slice(), lambda x: ordered.stream_queue_avg(x.select("pod", "ts", beat))).filter("pod <> 'heartbeat'")
    return out.groupBy("pod", F.expr("unix_micros(ts) div 86400000000").alias("day")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("avg_1m").alias("max_1m"), F.max("avg_5m").alias("max_5m"),
        F.round(F.sum("avg_1m"), 3).alias("sum_1m"), F.round(F.sum("avg_5m"), 3).alias("sum_5m"))


@query("stream_metrics", WITH_SERVED + """, steps AS (SELECT *, epoch_us(ts) // 15000000 + 1 AS g FROM served),
  spread AS (SELECT *, unnest(range(g, g + 20)) AS t FROM steps)
  SELECT t * 15000000 AS ts_us, count(*) FILTER (l1_hit) AS hits, count(*) FILTER (NOT l1_hit) AS calls,
    CAST(sum(cost_units) AS BIGINT) AS cost_units, CAST(sum(saved_units) AS BIGINT) AS saved_units,
    count(*) FILTER (latency_ms <= 10) AS le_0, count(*) FILTER (latency_ms <= 100) AS le_2,
    round(count(*) FILTER (l1_hit) / count(*), 9) AS hit_ratio FROM spread GROUP BY t""")
def _(s, d):
    e = served_log(s, d).select("ts", "tier", "latency_ms", "cost_units", "saved_units")
    out = _run(s, e, _month_slice(), windows.stream_metrics).filter("hits + calls > 0")
    return out.select(us("ts"), "hits", "calls", "cost_units", "saved_units", "le_0", "le_2",
                      F.round("hit_ratio", 9).alias("hit_ratio"))


@query("stream_dedup", WITH_SERVED + " SELECT DISTINCT cache_key FROM served")
def _(s, d):
    r = request_log(s, d).select("request_id", "ts", "cache_key")
    out = _run(s, r, _month_slice(), lambda x: windows.stream_dedup(x, "60 days"), heartbeat=False)
    return out.select("cache_key")


@query("stream_l2", BATCH_SQL["semantic_absorb"])
def _(s, d):
    r = _semantic_log(s, d)
    first = X.l1_attribute(r.select("request_id", "ts", "cache_key")).filter(~F.col("l1_hit")).select("request_id")
    log = r.join(first, "request_id", "left_semi").select("request_id", "ts", "query_text", "lang", "embedding")
    run = new_run_dir(s, "stream-l2")
    for _ in _slices(s, log, _month_slice(), f"{run}/in"):
        src = s.readStream.schema(log.schema).parquet(f"{run}/in")
        batches.stream_l2(src, f"{run}/store", f"{run}/out", f"{run}/state", _LONG).awaitTermination()
    found = s.read.parquet(f"{run}/out")
    return found.select("request_id", "l2_hit", "entry_id", F.round("similarity", 4).alias("similarity"), "stored")


@query("split_late", """WITH a AS (SELECT event_id, CAST(least(2, event_id * 3 // (SELECT count(*) FROM events)) AS INTEGER) AS b,
    CASE WHEN event_id % 100 = 7 THEN ts - INTERVAL 12 DAY ELSE ts END AS ts FROM events),
  m AS (SELECT b, max(ts) AS newest FROM a GROUP BY b)
  SELECT event_id, coalesce(ts < (SELECT max(newest) FROM m WHERE m.b < a.b) - INTERVAL 1 DAY, false) AS late FROM a""")
def _(s, d):
    e = events(s, d)
    shifted = F.when(F.col("event_id") % 100 == 7, F.col("ts") - F.expr("INTERVAL 12 DAYS")).otherwise(F.col("ts"))
    e = e.select("event_id", shifted.alias("ts"))
    total = e.agg(F.count(F.lit(1))).scalar()
    slice_ = F.least(F.lit(SLICES - 1), F.floor(F.col("event_id") * SLICES / total)).cast("int")
    run = new_run_dir(s, "late")
    for _ in _slices(s, e, slice_, f"{run}/in"):
        src = s.readStream.schema(e.schema).parquet(f"{run}/in")
        batches.split_late(src, f"{run}/ok", f"{run}/late", f"{run}/marks", f"{run}/state", 86400).awaitTermination()
    return s.read.parquet(f"{run}/ok").select("event_id", F.lit(False).alias("late")).unionByName(
        s.read.parquet(f"{run}/late").select("event_id", F.lit(True).alias("late")))
