"""Chat requests in three wire shapes, brought into one ``requests`` table.

Rows that the wire contract would refuse (no messages, no prompt, unreadable JSON) are
returned apart, never dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from promptlake import schemas
from promptlake.config import Config

_CONFIG = Config()
_SHAPES = {
    "openai": schemas.OPENAI_REQUEST,
    "ollama_chat": schemas.OLLAMA_CHAT_REQUEST,
    "ollama_generate": schemas.OLLAMA_GENERATE_REQUEST,
}


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def _bad_messages() -> Column:
    broken = F.exists(
        "messages", lambda m: m.isNull() | m["role"].isNull() | m["content"].isNull())
    return F.col("messages").isNull() | F.coalesce(broken, F.lit(False))


def _split(df: DataFrame, bad: Column, api: str, cfg: Config) -> tuple[DataFrame, DataFrame]:
    if _has(df, "_corrupt_record"):
        bad = bad | F.col("_corrupt_record").isNotNull()
    return _defaults(df.filter(~bad), api, cfg), df.filter(bad)


def _defaults(df: DataFrame, api: str, cfg: Config) -> DataFrame:
    cols = [
        F.col("request_id"), F.col("ts"),
        F.coalesce("user_id", F.lit(cfg.default_user)).alias("user_id"),
        F.coalesce("model", F.lit(cfg.default_model)).alias("model"),
        F.coalesce("stream", F.lit(False)).alias("stream"),
        F.transform(
            "messages",
            lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content")),
        ).alias("messages"),
        F.lit(api).alias("api"),
    ]
    if _has(df, "options"):
        cols.append(F.col("options"))
    return df.select(*cols)


def from_openai(df: DataFrame, cfg: Config = _CONFIG) -> tuple[DataFrame, DataFrame]:
    """(requests, bad requests) of the chat-completions shape."""
    return _split(df, _bad_messages(), "openai", cfg)


def from_ollama_chat(df: DataFrame, cfg: Config = _CONFIG) -> tuple[DataFrame, DataFrame]:
    """(requests, bad requests) of the native chat shape."""
    return _split(df, _bad_messages(), "ollama_chat", cfg)


def from_ollama_generate(df: DataFrame, cfg: Config = _CONFIG) -> tuple[DataFrame, DataFrame]:
    """(requests, bad requests) of the native generate shape: the prompt is one user message."""
    one = F.when(
        F.col("prompt").isNotNull(),
        F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
    return _split(df.withColumn("messages", one), F.col("prompt").isNull(), "ollama_generate", cfg)


ADAPTERS = {
    "openai": from_openai,
    "ollama_chat": from_ollama_chat,
    "ollama_generate": from_ollama_generate,
}


def read_requests(spark: SparkSession, path: str, fmt: str = "json", shape: str = "openai",
                  cfg: Config = _CONFIG, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """Read one wire shape from JSON lines or parquet, as a table or as a stream."""
    schema = _SHAPES[shape]
    if fmt != "json":
        schema = schema.replace(", _corrupt_record string", "")
    reader = (spark.readStream if streaming else spark.read).schema(schema)
    if fmt == "json":
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return ADAPTERS[shape](reader.format(fmt).load(path), cfg)


def unify_requests(*frames: DataFrame) -> DataFrame:
    """One request table; columns that a shape does not have are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
