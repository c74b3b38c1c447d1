"""Language codes from character n-gram profiles (naive Bayes with add-one smoothing)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from promptlake.session import cut

MAX_LANGS = 500  # a profile has one column per language


ROWS = 100_000


def _distinct_grams(text: str, n: int) -> tuple[list[str], np.ndarray]:
    """The different ``n``-grams of a text, and how often each occurs."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    size = len(points) - n + 1
    if size < 1:
        return [], np.empty(0, np.int64)
    if n > 3:  # three code points fill a number
        _, shorter = np.unique(np.lib.stride_tricks.sliding_window_view(points, n - 1), axis=0, return_inverse=True)
        _, first, counts = np.unique(shorter.ravel()[:size] << 21 | points[n - 1:], return_index=True, return_counts=True)
        return [text[i:i + n] for i in first.tolist()], counts
    codes = points[:size]
    for i in range(1, n):
        codes = codes << 21 | points[i:i + size]
    codes, counts = np.unique(codes, return_counts=True)
    parts = np.stack([codes >> 21 * (n - 1 - i) & 0x1FFFFF for i in range(n)], axis=1)
    joined = parts.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i:i + n] for i in range(0, len(joined), n)], counts


def _grams(df: DataFrame, text: str, keep: str, n_max: int) -> DataFrame:
    """(keep, gram, c): the different character n-grams of each whole text with their counts. A text
    repeats its grams, so they are counted before they become rows."""
    def count(batches):
        for batch in batches:
            rows, grams, counts = [], [], []
            for i, value in enumerate(batch["text"].to_pylist()):
                for n in range(1, n_max + 1) if value else ():
                    found, c = _distinct_grams(value, n)
                    rows.append(np.full(len(found), i))
                    grams += found
                    counts.append(c)
                if grams and (len(grams) >= ROWS or i == len(batch) - 1):
                    yield pa.RecordBatch.from_arrays(
                        [batch["keep"].take(pa.array(np.concatenate(rows))), pa.array(grams, pa.string()), pa.array(np.concatenate(counts))],
                        [keep, "gram", "c"])
                    rows, grams, counts = [], [], []

    d = df.select(F.col(keep).alias("keep"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(count, f"`{keep}` {d.schema['keep'].dataType.simpleString()}, gram string, c bigint")


def train_lang(df: DataFrame, text: str = "text", lang: str = "lang", n_max: int = 3) -> DataFrame:
    """Profiles (gram, lang, n, logp, floor): ``floor`` is the language's unseen-gram value.

    The counts are stored once; texts are not read again for the totals.
    """
    counts = cut(_grams(df.filter(F.col(lang).isNotNull()), text, lang, n_max).groupBy(
        F.col(lang).alias("lang"), "gram").agg(F.sum("c").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("_total"))
    vocabulary = counts.agg(F.count_distinct("gram")).scalar()
    per_lang = totals.withColumn("_d", F.log(F.col("_total") + vocabulary))
    return counts.join(F.broadcast(per_lang), "lang").select(  # one row per language
        "gram", "lang", "n", (F.log(F.col("n") + 1) - F.col("_d")).alias("logp"), (-F.col("_d")).alias("floor"))


def score_lang(df: DataFrame, profiles: DataFrame, rid: str, text: str = "text", n_max: int = 3) -> DataFrame:
    """(rid, lang, score) of the best language; texts without a gram get the empty code.

    The different grams of a text meet their profile row in a join whose strategy follows the
    profile's measured size, and collapse to one row per text before anything is shuffled.
    """
    floors = {r["lang"]: r["floor"] for r in
              profiles.groupBy("lang").agg(F.first("floor").alias("floor")).limit(MAX_LANGS + 1).collect()}
    if len(floors) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(floors)
    gains = profiles.groupBy("gram").agg(*[
        F.coalesce(F.max(F.when(F.col("lang") == g, F.col("logp") - F.col("floor"))), F.lit(0.0)).alias(f"g{i}")
        for i, g in enumerate(langs)])
    sums = _grams(df, text, rid, n_max).join(gains, "gram", "left").groupBy(rid).agg(
        F.sum("c").alias("_n"),
        *[F.coalesce(F.sum(F.col("c") * F.col(f"g{i}")), F.lit(0.0)).alias(f"s{i}") for i in range(len(langs))])
    best = F.greatest(*[
        F.struct((F.col("_n") * F.lit(floors[g]) + F.col(f"s{i}")).alias("score"), F.lit(g).alias("lang"))
        for i, g in enumerate(langs)]) if len(langs) > 1 else F.struct(
        (F.col("_n") * F.lit(floors[langs[0]]) + F.col("s0")).alias("score"), F.lit(langs[0]).alias("lang"))
    scored = sums.select(rid, best.alias("_b")).select(rid, "_b.lang", "_b.score")
    return df.select(rid).join(scored, rid, "left").select(
        rid, F.coalesce("lang", F.lit("")).alias("lang"), "score")
