"""Gateway event logs and captured answer streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptlake import schemas

# Fixed format: time, level, logger, JSON.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) (\S+) (\S+) (\{.*\})\s*$"
SSE_PREFIX = "data: "
_PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_gateway_events(lines: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(events, malformed lines) from log lines."""
    parsed = lines.withColumn(
        "_e",
        F.from_json(F.regexp_extract(col, LOG_LINE, 4), schemas.GATEWAY_EVENT, _PERMISSIVE))
    ok = F.col(col).rlike(LOG_LINE) & F.col("_e._corrupt_record").isNull() & F.col("_e.event").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    events = parsed.filter(ok).select(
        F.to_timestamp(F.regexp_extract(col, LOG_LINE, 1), "yyyy-MM-dd HH:mm:ss,SSS").alias("ts"),
        F.regexp_extract(col, LOG_LINE, 2).alias("level"),
        "_e.*",
    ).drop("_corrupt_record")
    return events, parsed.filter(~ok).select(col)


def read_gateway_events(spark: SparkSession, path: str, streaming: bool = False):
    """(events, malformed lines) of a log folder."""
    return parse_gateway_events((spark.readStream if streaming else spark.read).text(path))


def parse_stream_capture(lines: DataFrame, col: str = "line") -> DataFrame:
    """Chunk rows from captured server-sent events; other lines and broken JSON do not count."""
    body = F.trim(F.expr(f"substring({col}, {len(SSE_PREFIX) + 1})"))
    return (
        lines.filter(F.startswith(col, F.lit(SSE_PREFIX)))
        .withColumn("_c", F.from_json(body, schemas.STREAM_CHUNK, _PERMISSIVE))
        .filter(F.col("_c").isNotNull() & F.col("_c._corrupt_record").isNull())
        .select(
            *[c for c in lines.columns if c != col],
            F.coalesce("_c.content", F.lit("")).alias("delta"),
            F.coalesce("_c.done", F.lit(False)).alias("done"),
            F.col("_c.truncated").alias("truncated"),
            F.col("_c.error").alias("error")))
