"""Work that must not be repeated, and texts that must not move, as the input grows."""

import pytest
from pyspark.sql import functions as F

from promptlake.catalog import base, streams
from promptlake.operators import exact_cache
from promptlake.session import new_run_dir

START = 1_704_067_200


def counted(spark, df):
    """``df`` with a column that counts how often its rows are worked out."""
    seen = spark.sparkContext.accumulator(0)

    def one(x):
        seen.add(1)
        return x

    return df.withColumn("x", F.udf(one, "long").asNondeterministic()("x")), seen


def test_slices_are_worked_out_once(spark):
    df, seen = counted(spark, spark.range(30).select(F.col("id").alias("x")))
    for _ in streams._slices(spark, df, (F.col("x") % 3).cast("int"), new_run_dir(spark, "slices")):
        pass
    assert seen.value == 30


@pytest.mark.parametrize("parts", [2, 1440])
def test_requests_are_worked_out_once(spark, parts):
    df, seen = counted(spark, spark.range(60).select(F.col("id").alias("x")))
    df = df.select(
        F.col("x").cast("string").alias("request_id"), (F.col("x") % 2).cast("string").alias("cache_key"),
        F.timestamp_seconds(F.lit(START) + F.col("x") * 20_000).alias("ts"))
    assert len(exact_cache.l1_attribute(df, parts=parts).collect()) == 60
    assert seen.value == 60


def test_the_log_picks_out_texts_without_moving_them(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}", "en") for i in range(50)] + [(3, "text 3 again", "en"), (None, "no id", "en")],
                          "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 5, "view", 1.5, None if i == 8 else f'{{"k": {i % 7 + 45}}}') for i in range(20)] + [(20, 5, "view", 1.5, '{"k": 3}')],
                          "event_id long, user_id long, event_type string, value double, props string").withColumn(
        "ts", F.timestamp_seconds(F.lit(START) + F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    read = lambda: base.request_log(spark, str(tmp_path), with_text=True)
    few = read()
    semi = [line for line in plan(few).splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi)
    monkeypatch.setattr(base, "FEW_IDS", 0)
    many = read()
    assert "LeftSemi" not in plan(many)
    rows = sorted((tuple(r) for r in few.select(*sorted(few.columns)).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in many.select(*sorted(few.columns)).collect()), key=repr)
    want = sorted([(str(i), f"text {i % 7 + 45}") for i in range(20) if i != 8 and i % 7 + 45 < 50] + [("20", "text 3"), ("20", "text 3 again")])
    assert sorted((r["request_id"], r["query_text"]) for r in few.collect()) == want
