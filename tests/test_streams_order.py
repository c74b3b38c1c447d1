"""Ordered streams over several batches: rows on the watermark itself, rows that come late within
the delay, and chunks that change places between batches, against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from promptlake.operators import exact_cache, queue, quota, truncate
from promptlake.session import new_run_dir
from promptlake.streaming import batches, ordered

START = 1_704_067_200
STEP = 8_640


def replay(spark, slices, operator):
    """``operator`` over slices of rows, each a batch taken by a new start of the stream."""
    run, path = new_run_dir(spark, "stream"), new_run_dir(spark, "slices")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # few keys
    try:
        for df in slices:
            df.coalesce(1).write.mode("append").parquet(path)
            stream = operator(spark.readStream.schema(slices[0].schema).parquet(path))
            batches.run_available(stream, f"{run}/out", f"{run}/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(stream.schema).parquet(f"{run}/out")


def far(df):
    """One row of another key, long after all others."""
    return df.limit(1).select(*[F.lit("far").cast(t).alias(c) if t == "string" else F.timestamp_seconds(F.lit(4_102_444_800)).alias(c) if c == "ts"
                                else F.lit(1).cast(t).alias(c) for c, t in df.dtypes])


def in_three(df, key):
    third = F.floor(F.col("n") / 100)
    return [df.filter(third == i).drop("n") for i in range(3)] + [far(df.drop("n"))]


@pytest.fixture(scope="module")
def grid(spark):
    """300 rows of one key at even distance: with a delay of that distance, or a multiple, some row
    stands exactly on every watermark."""
    return spark.range(300).select(
        F.col("id").alias("n"), F.format_string("r%04d", "id").alias("request_id"), F.timestamp_seconds(F.lit(START) + F.col("id") * STEP).alias("ts"))


DELAYS = ["8640 seconds", "8639 seconds"]


@pytest.mark.parametrize("delay", DELAYS)
def test_exact_tier_on_the_watermark(spark, grid, delay):
    df = grid.withColumn("cache_key", F.lit("k"))
    out = replay(spark, in_three(df, "cache_key"), lambda s: ordered.stream_l1(s, 50_000, delay)).filter("request_id <> 'far'")
    want = exact_cache.l1_attribute(df, 50_000)
    rows = lambda d, at: sorted((r[0], r[1], r[2]) for r in d.select("request_id", "l1_hit", at).collect())
    assert rows(out, "anchor_us") == rows(want, F.unix_micros("anchor_ts"))


@pytest.mark.parametrize("delay", DELAYS[:1])
def test_quota_on_the_watermark(spark, grid, delay):
    df = grid.withColumn("user_id", F.lit("u")).withColumn("tokens", F.col("n") % 7)
    out = replay(spark, in_three(df, "user_id"), lambda s: ordered.stream_quota(s, 300, delay)).filter("request_id <> 'far'")
    names = ["request_id", "admitted", "used_before", "status"]
    rows = lambda d: sorted(tuple(r) for r in d.select(*names).collect())
    assert rows(out) == rows(quota.quota_gate(df, 300))


@pytest.mark.parametrize("delay", DELAYS[:1])
def test_means_on_the_watermark(spark, grid, delay):
    df = grid.select("n", F.lit("p").alias("pod"), "ts", (F.col("n") * 7 % 11).alias("depth"))
    out = replay(spark, in_three(df, "pod"), lambda s: ordered.stream_queue_avg(s, 3, 5, delay)).filter("pod <> 'far'")
    found = {r["ts"]: (r["depth"], round(r["avg_1m"], 9), round(r["avg_5m"], 9)) for r in out.collect()}
    depths = [7 * n % 11 for n in range(300)]
    mean = lambda n, w: round(sum(depths[max(0, n + 1 - w):n + 1]) / min(w, n + 1), 9)
    want = {r["ts"]: (depths[r["n"]], mean(r["n"], 3), mean(r["n"], 5)) for r in df.collect()}
    assert found == want


def test_rows_out_of_order_within_the_delay(spark):
    """Microseconds within one millisecond, equal times, rows later than their successors by up to the
    delay, two keys and several hour buckets."""
    rng = random.Random(11)
    rows = []
    for i in range(600):
        us = (START * 1_000_000) + i * 61_000_000 + rng.choice([0, 1, 999, 1000, rng.randrange(10**6)])
        rows.append((rng.choice("ab"), f"r{i:04d}", us, us + rng.randrange(1_800_000_000)))  # by arrival: half an hour at most
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[3]), "cache_key string, request_id string, us long, arrival long")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    cuts = [sorted(r[3] for r in rows)[i] for i in (150, 300, 450)]
    part = sum((F.col("arrival") >= c).cast("int") for c in cuts[1:]) + (F.col("arrival") >= cuts[0]).cast("int")
    plain = df.select("cache_key", "request_id", "ts")
    slices = [df.filter(part == i).select(*plain.columns) for i in range(4)]
    out = replay(spark, [*slices, far(plain)], lambda s: ordered.stream_l1(s, 3_000, "1 hour")).filter("request_id <> 'far'")
    got = {r["request_id"]: (r["l1_hit"], r["anchor_us"]) for r in out.collect()}
    want = {r["request_id"]: (r["l1_hit"], r["a"]) for r in exact_cache.l1_attribute(plain, 3_000).withColumn("a", F.unix_micros("anchor_ts")).collect()}
    assert got == want and out.count() == 600


def chunk_rows():
    rng = random.Random(3)
    rows = []
    for r in range(12):
        most = rng.choice([None, 0, 1, 5, 12])
        rows += [(f"r{r}", seq, rng.choice(["", "ab", "é" * 9, "x" * rng.randrange(40)]), most) for seq in range(rng.randrange(1, 14))]
    return rows


def test_truncation_equals_a_walk(spark):
    df = spark.createDataFrame(chunk_rows(), "response_id string, seq int, delta string, predicted_max int")
    want = set()
    for r in {x[0] for x in chunk_rows()}:
        total = 0
        for _, seq, delta, most in sorted(x for x in chunk_rows() if x[0] == r):
            if not delta:
                continue
            total += len(delta.encode())
            cut = most is not None and max(1, total // 4) > int(most * 1.5)
            want.add((r, seq, delta + truncate.MARK * cut, max(1, total // 4), cut))
            if cut:
                break
    names = ["response_id", "seq", "delta", "tokens_so_far", "truncated"]
    assert {tuple(x[n] for n in names) for x in truncate.truncate_stream(df).collect()} == want


def test_chunks_that_change_places_between_batches(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(*x, rng.randrange(4)) for x in chunk_rows()], "response_id string, seq int, delta string, predicted_max int, b int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("seq")))
    names = ["response_id", "seq", "delta", "tokens_so_far", "truncated"]
    out = replay(spark, [df.filter(F.col("b") == i).drop("b") for i in range(4)], ordered.stream_truncate)
    rows = lambda d: sorted(tuple(x) for x in d.select(*names).collect())
    assert rows(out) == rows(truncate.truncate_stream(df.drop("b", "ts")))


def test_a_missing_chunk_is_passed_over_when_the_response_is_closed(spark):
    df = spark.createDataFrame([("r", 0, "abcd", 100), ("r", 2, "efgh", 100), ("r", 5, "ij", 100)], "response_id string, seq int, delta string, predicted_max int")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(START) + F.col("seq")))
    first = replay(spark, [df], ordered.stream_truncate)
    assert [r["seq"] for r in first.collect()] == [0]
    out = replay(spark, [df, far(df).withColumn("seq", F.lit(0)).select(*df.columns), far(df).withColumn("seq", F.lit(1)).select(*df.columns)], ordered.stream_truncate)
    assert sorted((r["seq"], r["tokens_so_far"]) for r in out.filter("response_id = 'r'").collect()) == [(0, 1), (2, 2), (5, 2)]
