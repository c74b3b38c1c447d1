"""Cutting streamed answers that run past their predicted length."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.functions.cost import token_limit
from promptlake.operators.ordered import running_sum

MARK = "[TRUNCATED]"  # fixed value


def truncate_stream(chunks: DataFrame, factor: float = 1.5) -> DataFrame:
    """Chunks (response_id, seq, delta, predicted_max) up to the first one at which the
    tokens so far pass the limit; that one carries the mark. Empty deltas do not count.

    Byte lengths add up under concatenation, so a prefix sum of lengths gives the tokens. The sum
    only grows: a chunk is kept if those before it were within the limit, and marked if it is not.
    Without a limit nothing is cut.
    """
    size = F.octet_length("delta").cast("bigint")
    d = running_sum(
        chunks.filter(F.coalesce(F.octet_length("delta"), F.lit(0)) > 0), size, ["response_id"], ["seq"],
        F.floor(F.col("seq") / 4096).cast("bigint"), "bytes_so_far")
    tokens = lambda n: F.greatest(F.lit(1).cast("bigint"), F.floor(n / 4).cast("bigint"))
    limit = token_limit("predicted_max", factor)
    before = F.col("bytes_so_far") - size
    kept = d.filter(F.coalesce((before == 0) | (tokens(before) <= limit), F.lit(True)))
    over = F.coalesce(tokens(F.col("bytes_so_far")) > limit, F.lit(False))
    return (
        kept.withColumn("tokens_so_far", tokens(F.col("bytes_so_far"))).withColumn("truncated", over)
        .withColumn("delta", F.when(F.col("truncated"), F.concat("delta", F.lit(MARK))).otherwise(F.col("delta")))
        .drop("bytes_so_far"))
