"""Where a user's own embedding model or answering model plugs in.

Both take a factory: it runs once per Python worker and returns the function to call, so a
model is loaded once and not per batch. Filter before calling: Catalyst does not move a
filter past a Python function.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def embed(df: DataFrame, factory: Callable, col: str = "query_text", out: str = "embedding") -> DataFrame:
    """Adds unit-length vectors. The function maps a list of texts to a matrix; rows it maps
    to zero get no vector. Write or persist the result when it is used twice."""
    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encode = factory()
        for texts in batches:
            m = np.asarray(encode(texts.fillna("").tolist()), dtype="float64")
            norm = np.linalg.norm(m, axis=1) if len(m) else np.zeros(0)
            yield pd.Series([
                (row / n).astype("float32") if n > 0 else None for row, n in zip(m, norm)], dtype="object")

    return df.withColumn(out, vectors(F.col(col)))


def answer(misses: DataFrame, factory: Callable) -> DataFrame:
    """Adds content, input_tokens and output_tokens to requests that miss. The function takes
    (query_text, model) and returns the three values."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    schema = StructType([
        *misses.schema.fields, StructField("content", StringType()),
        StructField("input_tokens", IntegerType()), StructField("output_tokens", IntegerType())])

    def call(batches):
        reply = factory()
        for pdf in batches:
            rows = [reply(t, m) for t, m in zip(pdf["query_text"], pdf["model"])]
            new = pd.DataFrame(rows, columns=["content", "input_tokens", "output_tokens"], index=pdf.index)
            yield pd.concat([pdf, new], axis=1)

    return misses.mapInPandas(call, schema)
