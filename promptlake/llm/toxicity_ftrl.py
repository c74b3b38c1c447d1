"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, their five-byte beginnings, its word pairs
and its pairs with one word between. Each coordinate has its own learning rate, and the L1 term
keeps coordinates at zero until their evidence outweighs it, so the weights that travel are few.
The model is fitted on a bounded sample of labelled rows (``max_rows``, in hash order of the id, of
texts up to ``max_chars`` characters), in one task; every text is scored whole.

Null or wordless text: the score of the bias alone. Repeated ids in the labels: the largest label
counts. No labelled rows: every score is 0.5. Rows are scored alone, so repeats do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptlake.llm.batches import add_columns, chunks, letter_words, mix, span_hashes

STEMS = (4, 6)


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) for every occurrence of a feature."""
    buf, starts, ends, text_of = letter_words(texts)
    if len(starts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = span_hashes(buf, starts, ends)
    stems = [mix(span_hashes(buf, starts, np.minimum(ends, starts + k)) ^ np.uint64(0x5DEECE66D + k)) for k in STEMS]
    pair = mix(word[:-1] * np.uint64(3) + word[1:])
    skip = mix(word[:-2] * np.uint64(5) + word[2:] + np.uint64(1))
    near, far = text_of[:-1] == text_of[1:], text_of[:-2] == text_of[2:]
    at = np.concatenate([*[text_of] * (1 + len(STEMS)), text_of[:-1][near], text_of[:-2][far]])
    h = np.concatenate([word, *stems, pair[near], skip[far]])
    return at, (h >> np.uint64(64 - bits)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, alpha: float, beta: float, l1: float, l2: float,
        epochs: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; index 2**bits is the bias."""
    n = np.zeros((1 << bits) + 1)
    z = np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits])

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        return w

    order = np.random.default_rng(11)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = np.concatenate([rows[r], bias])
            w = weights(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[r]
            root = np.sqrt(n[i])
            z[i] += g - (np.sqrt(n[i] + g * g) - root) / alpha * w
            n[i] += g * g
    i = np.flatnonzero(np.abs(z) > l1)
    return i, weights(i)


def train(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic",
          bits: int = 20, max_rows: int = 20_000, max_chars: int = 50_000, alpha: float = 0.3, beta: float = 1.0,
          l1: float = 4.0, l2: float = 0.1, epochs: int = 3) -> dict[int, float]:
    """Weights by feature, learnt from rows of ``labels`` for which ``learn`` holds."""
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(max_rows)
    sample = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).filter(F.length("t") <= max_chars).join(
        F.broadcast(chosen), "k").select("t", "y", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys, hs = [], [], []
        for batch in batches:
            for lo, hi in chunks(batch["t"]):
                part = batch.slice(lo, hi - lo)
                at, f = features(part["t"], bits)
                both = np.unique(at << bits | f)
                cuts = np.searchsorted(both, np.arange(1, hi - lo) << bits)
                rows += [(x & ((1 << bits) - 1)).astype(np.int32) for x in np.split(both, cuts)]
                ys += part["y"].to_pylist()
                hs += part["h"].to_pylist()
        if rows:
            by = sorted(range(len(rows)), key=lambda i: (hs[i], ys[i], len(rows[i])))  # whatever order the rows came in
            i, w = fit([rows[j] for j in by], np.array([ys[j] for j in by]), bits, alpha, beta, l1, l2, epochs)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w)], ["i", "w"])

    model = sample.repartition(1).mapInArrow(run, "i long, w double").collect()
    return {r["i"]: r["w"] for r in model}


def score(docs: DataFrame, weights: dict[int, float], text: str = "text", bits: int = 20) -> DataFrame:
    """``docs`` with ``score``: the chance that a text is toxic."""
    bias = weights.get(1 << bits, 0.0)
    index = np.array(sorted(i for i in weights if i < 1 << bits), np.int64)
    value = np.array([weights[i] for i in index.tolist()])

    def make(texts: pa.Array) -> dict:
        table = np.zeros(1 << bits, np.float32)
        table[index] = value
        at, f = features(texts, bits)
        w = table[f]
        hit = w != 0
        both = np.unique(at[hit] << bits | f[hit])
        total = bias + np.bincount(both >> bits, weights=table[both & ((1 << bits) - 1)].astype(float), minlength=len(texts))
        return {"score": 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))}

    return add_columns(docs, text, "score double", make)
