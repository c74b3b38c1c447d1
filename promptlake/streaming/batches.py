"""Streaming operators that work micro-batch by micro-batch on stored tables.

Every batch writes below a folder of its own number, so a repeated batch replaces what it
wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptlake.config import Config
from promptlake.functions.text import extract_keywords
from promptlake.operators.absorb import semantic_absorb
from promptlake.rules import Rules

_CONFIG = Config()
_RULES = Rules()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run an appending stream over all that is there, into parquet."""
    q = stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """What batches before ``batch_id`` wrote; empty before the first."""
    full = schema + ", batch_id bigint"
    try:
        return spark.read.schema(full).parquet(path).filter(F.col("batch_id") < batch_id)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], full)


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


_STORE = ("entry_id string, embedding array<float>, lang string, keywords array<string>, "
          "stored_at timestamp, expires_at timestamp")


def stream_l2(requests: DataFrame, store_path: str, out_path: str, checkpoint: str, cfg: Config = _CONFIG,
              rules: Rules = _RULES, **layout):
    """Streaming semantic tier: each batch is settled against the live entries of the store
    table and against itself, and its new entries are added to the store. Returns the query.

    Batches must arrive in time order for the outcome to equal the batch operator's.
    """
    def settle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.select("request_id", "ts", "query_text", "lang", "embedding").persist()
        first = batch.agg(F.min("ts")).first()[0]
        if first is not None:
            live = _earlier(spark, store_path, batch_id, _STORE).filter(F.col("expires_at") > F.lit(first))
            out = semantic_absorb(batch, cfg.threshold, cfg.k, cfg.ttl_s, cfg.max_chars, rules,
                                  initial=live.drop("batch_id"), **layout)
            new = batch.join(out.filter("stored").select("request_id"), "request_id", "left_semi").select(
                F.col("request_id").alias("entry_id"), "embedding", "lang",
                extract_keywords("query_text", rules).alias("keywords"), F.col("ts").alias("stored_at"),
                F.timestamp_micros(F.unix_micros("ts") + cfg.ttl_s * 1_000_000).alias("expires_at"))
            _write(new, store_path, batch_id)
            _write(out.drop("round"), out_path, batch_id)
        batch.unpersist()

    return requests.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def split_late(stream: DataFrame, accepted: str, late: str, marks: str, checkpoint: str, delay_s: int = 3600):
    """Rows older than the watermark (newest time of earlier batches minus the delay) go to a
    quarantine table with a reason, the rest to the accepted table. Returns the query; late
    rows can be replayed in batch."""
    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mark = _earlier(spark, marks, batch_id, "newest_us bigint").agg(F.max("newest_us")).first()[0]
        us = F.unix_micros("ts")
        is_late = (us < mark - delay_s * 1_000_000) if mark is not None else F.lit(False)
        batch = batch.persist()
        _write(batch.filter(~is_late), accepted, batch_id)
        _write(batch.filter(is_late).withColumn("reason", F.lit("later than watermark")), late, batch_id)
        _write(batch.agg(F.max(us).alias("newest_us")), marks, batch_id)
        batch.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
