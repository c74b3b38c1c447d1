"""Answers in wire shapes: bodies, chunk rows, NDJSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _created(created_at: str):
    return F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("created_at")


def _counts():
    return [
        F.lit(True).alias("done"),
        F.lit(0).alias("total_duration"),
        F.lit(0).alias("prompt_eval_count"),
        F.coalesce("tokens_used", F.lit(0)).alias("eval_count"),
    ]


def to_ollama_chat(responses: DataFrame, created_at: str = "ts") -> DataFrame:
    """Adds ``body``: the native chat answer as JSON."""
    message = F.struct(F.lit("assistant").alias("role"), F.col("content").alias("content"))
    return responses.withColumn("body", F.to_json(F.struct(
        "model", _created(created_at), message.alias("message"), *_counts())))


def to_ollama_generate(responses: DataFrame, created_at: str = "ts") -> DataFrame:
    """Adds ``body``: the native generate answer as JSON."""
    return responses.withColumn("body", F.to_json(F.struct(
        "model", _created(created_at), F.col("content").alias("response"), *_counts())))


def to_ndjson(chunks: DataFrame, api: str = "chat") -> DataFrame:
    """Adds ``line``: one NDJSON line per chunk (``delta``, ``done``, ``model``).

    Only the last chunk of the chat shape carries a total duration; to_json leaves out nulls.
    """
    if api == "chat":
        message = F.struct(F.lit("assistant").alias("role"), F.col("delta").alias("content"))
        body = F.struct(
            "model", message.alias("message"), "done",
            F.when(F.col("done"), F.lit(0)).alias("total_duration"))
    elif api == "generate":
        body = F.struct("model", F.col("delta").alias("response"), "done")
    else:
        raise ValueError("api is 'chat' or 'generate'")
    return chunks.withColumn("line", F.to_json(body))


def to_chunks(responses: DataFrame, content: str = "content") -> DataFrame:
    """A complete answer as a two-chunk stream: everything, then the end mark."""
    part = lambda seq, delta, done, cut: F.struct(
        F.lit(seq).alias("seq"), delta.alias("delta"), F.lit(done).alias("done"),
        F.lit(cut).cast("boolean").alias("truncated"))
    both = F.array(part(0, F.col(content), False, None), part(1, F.lit(""), True, False))
    rest = [c for c in responses.columns if c != content]
    return responses.select(*rest, F.explode(both).alias("_p")).select(*rest, "_p.*")
