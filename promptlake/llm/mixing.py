"""Mixing sources to target weights by temperature.

Token counts per source give shares; the shares to the power of an exponent, renormalised, are the
target weights. The exponent is bisected: from 1 (as found) towards 0 (all alike) until the weights
reach a target entropy, or as far as the largest number of passes over any source allows. Weights
become budgets of tokens; each source's documents are dealt into blocks by a seeded hash, the blocks
and the documents in them follow in hash order, whole passes come first and one pass is cut where
the budget ends. A block holds a bounded number of tokens on average, so the running sums need the
short list of blocks and a window per (source, block): no task holds a source.

Null source: a source of its own, under the name ''. Null or wordless text: no tokens; it is taken
as often as the whole passes say, and in the cut pass if it comes before the cut. Repeated rows
are dealt alike and follow each other. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.session import cut

WORD = "[^\\x20\\x09-\\x0D]+"


def n_tokens(text: str = "text") -> Column:
    """Words of a text."""
    return F.size(F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(WORD), 0)).cast("long")


def temper(counts: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(counts.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in counts.items()}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def passes(counts: dict[str, int], weights: dict[str, float], budget: float) -> float:
    return max((weights[s] * budget / n for s, n in counts.items() if n), default=0.0)


def choose_exponent(counts: dict[str, int], budget: float, target: float, max_passes: float, steps: int = 60) -> float:
    """The largest exponent in [0, 1] that reaches ``target`` of the greatest entropy, moved back
    towards 1 until no source is passed more than ``max_passes`` times."""
    full = {s: n for s, n in counts.items() if n}
    if len(full) < 2:
        return 1.0

    def bisect(good) -> float:  # good at 1, not at 0
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if good(mid) else (mid, hi)
        return hi

    goal = target * math.log(len(full))
    enough = lambda x: entropy(temper(full, x)) >= goal - 1e-12
    few = lambda x: passes(full, temper(full, x), budget) <= max_passes + 1e-12
    exponent = 1.0 if enough(1.0) else 0.0 if not enough(0.0) else 1.0 - bisect(lambda x: enough(1.0 - x))
    if few(exponent) or not few(1.0):
        return exponent if few(exponent) else 1.0
    return bisect(few)


def source_tokens(counted: DataFrame, max_sources: int) -> dict[str, int]:
    """Tokens of each source; the number of sources is bounded, beyond the bound this fails loudly."""
    rows = counted.groupBy("s").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources: give a coarser source column")
    return {r["s"]: r["n"] for r in rows}


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", target: float = 0.98,
        max_passes: float = 4.0, budget_share: float = 1.0, block_tokens: int = 200_000, seed: int = 7,
        max_sources: int = 100_000) -> DataFrame:
    """(key, source, n_tokens, copies, weight, block, place): how often each row of ``docs`` is taken.

    ``budget_share``: tokens to take, as a share of those there. ``place``: tokens that come before
    the row in its source's permutation.
    """
    spark = docs.sparkSession
    counted = cut(docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("s"), n_tokens(text).alias("n")))
    counts = source_tokens(counted, max_sources)
    total = sum(counts.values())
    budget = total * budget_share
    weights = temper(counts, choose_exponent(counts, budget, target, max_passes)) if total else {s: 0.0 for s in counts}
    plan = spark.createDataFrame(
        [(s, n, float(weights[s]), int(round(weights[s] * budget)), max(1, -(-n // block_tokens))) for s, n in counts.items()],
        "s string, have long, weight double, budget long, blocks long")
    order = F.xxhash64(F.lit(seed), "k", "n")
    dealt = counted.join(F.broadcast(plan), "s").withColumn("h", order).withColumn("block", F.pmod("h", "blocks"))
    sums = dealt.groupBy("s", "block").agg(F.sum("n").alias("in_block"))
    before = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "block", F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("s", "block").orderBy("h", "k", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, ["s", "block"]).withColumn("place", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    whole = F.when(F.col("have") > 0, F.floor(F.col("budget") / F.col("have"))).otherwise(1).cast("long")
    rest = F.col("budget") - whole * F.col("have")
    copies = whole + F.when((F.col("have") > 0) & (F.col("place") + F.col("n") <= rest) & (F.col("n") > 0), 1).otherwise(0)
    return placed.select(
        F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias("n_tokens"), copies.alias("copies"),
        "weight", "block", "place")


def take(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, each as often as ``mix`` says, with their columns.

    Rows without an id are taken once: no budget can be tied to them.
    """
    plan = mix(docs, key, **options)
    name = F.col(f"`{key}`")
    copies = plan.filter(name.isNotNull()).groupBy(name.alias("__k")).agg(F.min("copies").alias("__n"))
    rows = docs.join(copies.filter("__n > 0"), docs[f"`{key}`"] == F.col("__k"))
    out = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*[docs[f"`{c}`"] for c in docs.columns])
    return out.unionByName(docs.filter(name.isNull()))
