"""The streaming semantic tier against the batch operator."""

from pyspark.sql import functions as F

from promptlake.config import Config
from promptlake.operators.absorb import semantic_absorb
from promptlake.streaming.batches import stream_l2
from test_caches import SCHEMA, frame, semantic_log


def test_semantic_tier_in_batches(spark, tmp_path):
    rows = sorted(semantic_log(21, 60, 8), key=lambda r: (r[1], r[0]))
    df = frame(spark, rows, SCHEMA).select("request_id", "ts", "query_text", "lang", "embedding")
    times = sorted({r[1] for r in rows})
    cut = times[len(times) // 2]
    for part in (df.filter(F.unix_timestamp("ts") < cut), df.filter(F.unix_timestamp("ts") >= cut)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    cfg = Config(ttl_s=900, threshold=0.6)
    stream_l2(src, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/state", cfg).awaitTermination()
    got = {r.request_id: (r.l2_hit, r.entry_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {r.request_id: (r.l2_hit, r.entry_id) for r in semantic_absorb(df, 0.6, 3, 900).collect()}
    assert got == want
