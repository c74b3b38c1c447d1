"""Streamed truncation keeps the state of many responses together."""

import json

from pyspark.sql import functions as F

from promptlake.operators import truncate
from promptlake.session import new_run_dir
from promptlake.streaming import ordered
from test_streams_order import START, far, replay

CHUNK = "response_id long, seq int, ts_s long, delta string, predicted_max int"
NAMES = ["response_id", "seq", "delta", "tokens_so_far", "truncated"]


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, CHUNK).withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("ts_s"))).drop("ts_s")


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_truncation_keeps_state_for_buckets_of_responses(spark):
    rows = [(None if r == 7 else r, seq, seq, "é" * (r % 9 + seq), r % 5 or None) for r in range(200) for seq in range(5)]
    df = chunk_frame(spark, rows)
    run, path = new_run_dir(spark, "stream"), new_run_dir(spark, "slices")
    most = 0
    for part in (F.col("seq").isin(0, 3), F.col("seq").isin(1, 4), F.col("seq") == 2):
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
        stream = ordered.stream_truncate(spark.readStream.schema(df.schema).parquet(path), buckets=2)
        q = stream.writeStream.format("parquet").option("path", f"{run}/out").option(
            "checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        most = max(most, *[json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress])
    out = spark.read.schema(stream.schema).parquet(f"{run}/out")
    assert out.schema["response_id"].dataType == df.schema["response_id"].dataType
    assert rows_of(out) == rows_of(truncate.truncate_stream(df.drop("ts")))
    assert most < 20  # not one row and more for each of the 200 responses


def test_responses_of_a_bucket_close_on_their_own(spark):
    first = [(1, 0, 0, "abcd", 100), (1, 2, 0, "efgh", 100), (2, 0, 5000, "abcd", 100), (2, 2, 5000, "efgh", 100)]
    # moves the watermark past the end of 1, not of 2; then 2 gets what was missing
    later, last = [(3, 0, 6000, "x", 100)], [(2, 1, 6000, "ijkl", 100), (2, 2, 6000, "efgh", 100)]
    op = lambda s: ordered.stream_truncate(s, buckets=1)
    frames = [chunk_frame(spark, x) for x in (first, later, last)]
    got = [(r[0], r[1], r[3]) for r in rows_of(replay(spark, [*frames, far(frames[0]).withColumn("seq", F.lit(0))], op)) if r[2] != "far"]
    assert got == [(1, 0, 1), (1, 2, 2), (2, 0, 1), (2, 1, 2), (2, 2, 3), (3, 0, 1)]
