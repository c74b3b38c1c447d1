"""Filter interaction audit over a sparse document-term matrix.

Texts are gathered into shards of some megabytes. Each shard numbers its own words, which become rows of
a matrix in compressed sparse form: row borders, column numbers, counts. The words of all shards make
one dictionary: a word's number there is its place in the first shard that has it. A row's sum is the text's number of words, its
nonzero cells are the distinct words. What else decides (letters, signs, copies) is attached to the
rows, which become one number of five bits each; all 120 orders follow from the 32 sums
of rows that no filter of a set rejects.

A word comes to the dictionary once per shard, so even the commonest one is a small share of what is
shuffled, and only words that an earlier shard owns come back to a shard.

Null text counts as empty, and equals other empty texts. Null part: the part ''. A row without an id
is no copy of another and has no labels. Repeated rows are counted each; rows with equal id and text
are no copies of each other. Rows without words have empty matrix rows. A text longer than a shard is
a shard of its own. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.llm.batches import chunks, is_space, text_bytes, word_spans
from promptlake.session import cut

CHUNK, SHARD = 1 << 22, 1 << 25  # bytes of text
FILTERS = "ABCDE"
SIGNS = b"#$%&*|"
_STORED = ("ids array<long>, parts array<string>, digests array<binary>, upper array<long>, points array<long>, signs array<boolean>, "
           "indptr array<long>, indices array<int>, data array<int>, words array<string>")


def encode_words(buf: np.ndarray, gap: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The runs outside ``gap`` as numbers into a list of distinct words, by their bytes."""
    ends_of = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_of), pa.py_buffer(buf[~gap])])
    return words.dictionary_encode()


def as_strings(words: pa.Array) -> pa.Array:
    """Bytes cut from valid texts, as strings."""
    return words.cast(pa.large_binary()).view(pa.large_string()).cast(pa.string())


def _csr(texts: pa.Array) -> tuple[dict[str, np.ndarray], pa.Array]:
    """Matrix rows of some texts and the list of their distinct words."""
    buf, offsets = text_bytes(texts)
    gap = is_space(buf)
    starts, ends, text_of = word_spans(gap, offsets)
    coded = encode_words(buf, gap, starts, ends)
    size = max(1, len(coded.dictionary))
    cells, counts = np.unique(text_of * size + np.asarray(coded.indices, np.int64), return_counts=True)
    sums = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets])
    return {
        "upper": sums((buf >= 65) & (buf <= 90)), "points": sums((buf & 0xC0) != 0x80), "signs": sums(np.isin(buf, np.frombuffer(SIGNS, np.uint8))) > 0,
        "cells": np.bincount(cells // size, minlength=len(texts)), "indices": cells % size, "data": counts.astype(np.int32)}, coded.dictionary


class _Shard:
    """A shard in the making: its rows chunk by chunk, over one growing list of words."""

    def __init__(self):
        self.parts: list[dict] = []
        self.words = pa.array([], pa.large_binary())
        self.size = 0

    def add(self, rows: pa.RecordBatch, size: int) -> None:
        found, words = _csr(rows["t"])
        both = pa.concat_arrays([self.words, words.cast(pa.large_binary())]).dictionary_encode()
        number = np.asarray(both.indices, np.int32)[len(self.words):]
        self.words = both.dictionary
        self.parts.append({"ids": rows["id"], "parts": rows["part"], "digests": rows["digest"], **found, "indices": number[found["indices"]]})
        self.size += size

    def row(self) -> pa.RecordBatch:
        joined = {n: pa.concat_arrays([p[n] for p in self.parts]) for n in ("ids", "parts", "digests")}
        joined |= {n: pa.array(np.concatenate([p[n] for p in self.parts])) for n in ("upper", "points", "signs")}
        border = np.concatenate([[0], np.cumsum(np.concatenate([p["cells"] for p in self.parts]))])
        joined |= {"indptr": pa.array(border), **{n: pa.array(np.concatenate([p[n] for p in self.parts])) for n in ("indices", "data")}, "words": as_strings(self.words)}
        return pa.RecordBatch.from_arrays([_one(c) for c in joined.values()], list(joined))


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def csr_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per shard of the matrix: its documents (``ids``, ``parts``, ``digests``), their other
    measures (``upper``, ``points``, ``signs``), row borders ``indptr``, word numbers within the shard
    ``indices`` (``n_own`` of them), counts ``data``, and ``columns``: the dictionary's number of each
    word that an earlier shard owns."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
                       F.unhex(F.sha2(t, 256)).alias("digest"), t.alias("t"))

    chunk, most = CHUNK, SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for lo, hi in chunks(batch["t"], chunk):
                shard.add(own := batch.slice(lo, hi - lo), own["t"].nbytes)
                if shard.size >= most:
                    yield shard.row()
                    shard = _Shard()
        if shard.parts:
            yield shard.row()

    shards = cut(rows.mapInArrow(run, _STORED).withColumn("shard", F.monotonically_increasing_id()))
    said = shards.select("shard", F.posexplode("words").alias("at", "word"))
    first = F.min(F.struct("shard", "at")).over(Window.partitionBy("word"))
    taken = said.select("shard", "at", first.alias("first")).filter("first.shard <> shard")
    columns = taken.groupBy("shard").agg(F.collect_list(F.struct("at", F.col("first.shard").alias("owner"), F.col("first.at").alias("number"))).alias("columns"))
    n_words = shards.withColumn("n_own", F.size("words")).drop("words")
    return n_words.join(columns, "shard", "left").withColumn("columns", F.coalesce("columns", F.array().cast(columns.schema["columns"].dataType)))


def _columns(shard: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """The dictionary's numbers of a shard's words: the shard that owns each, and its number there."""
    n = shard["n_own"][0].as_py()
    owner, number = np.full(n, shard["shard"][0].as_py(), np.int64), np.arange(n)
    given = shard["columns"].flatten()
    at, *taken = (np.asarray(given.field(c), np.int64) for c in ("at", "owner", "number"))
    owner[at], number[at] = taken
    return owner, number


def measures(shards: DataFrame) -> DataFrame:
    """(id, part, digest, n_words, n_distinct, upper, points, signs) of every row of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = batch.slice(i, 1)
                owner, number = _columns(shard)
                order = np.lexsort((number, owner))
                if ((np.diff(owner[order]) == 0) & (np.diff(number[order]) == 0)).any():
                    raise ValueError("two words of a shard have one column")
                own = {n: shard[n].flatten() for n in ("ids", "parts", "digests", "upper", "points", "signs", "indptr", "data")}
                border = np.asarray(own["indptr"], np.int64)
                total = np.concatenate([[0], np.cumsum(np.asarray(own["data"], np.int64))])
                yield pa.RecordBatch.from_arrays(
                    [own["ids"], own["parts"], own["digests"], pa.array(np.diff(total[border])), pa.array(np.diff(border)), own["upper"], own["points"], own["signs"]],
                    ["id", "part", "digest", "n_words", "n_distinct", "upper", "points", "signs"])

    return shards.select("shard", "ids", "parts", "digests", "upper", "points", "signs", "indptr", "data", "n_own", "columns").mapInArrow(
        run, "id long, part string, digest binary, n_words long, n_distinct long, upper long, points long, signs boolean")


def flags(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask): bit i of the mask is set if the row fails the i-th filter of ``FILTERS``."""
    rows = cut(measures(csr_shards(docs, key, text, part)))
    # E: all rows of a text but those with its smallest id; a text's id spreads its copies
    first = rows.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "id"], "left")
    fails = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * F.col("upper") > 2 * F.col("points"),
             F.col("signs"), F.col("id").isNotNull() & F.col("first").isNull()]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", mask.alias("mask"))


def _orders() -> Column:
    """Every order's steps: (filter_order, step, before, bit) with the earlier filters' bits."""
    rows = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        rows += [f"struct('{''.join(order)}' AS filter_order, {i + 1} AS step, {sum(bits[:i])} AS before, {b} AS bit)" for i, b in enumerate(bits)]
    return F.expr(f"array({', '.join(rows)})")


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what the step keeps, removes and would have removed."""
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality"), F.col("toxic")).groupBy("id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    per_mask = flags(docs, key, text, part).join(marks, "id", "left").groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    every = (1 << len(FILTERS)) - 1
    # rows that no filter of the set rejects
    spared = per_mask.withColumn("set", F.explode(F.filter(F.sequence(F.lit(0), F.lit(every)), lambda s: s.bitwiseAND(F.col("mask")) == 0)))
    per_set = spared.groupBy("part", "set").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    table = F.map_from_entries(F.collect_list(F.struct("set", F.struct("n", "good", "toxic"))))
    parts = per_mask.select("part").distinct().join(per_set.groupBy("part").agg(table.alias("m")), "part", "left")

    def sums(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(every)), lambda s: F.coalesce(F.element_at("m", s)[c], F.lit(0)).cast("long")).alias(c)

    parts = parts.select("part", *[sums(c) for c in ("n", "good", "toxic")])
    at = lambda c, s: F.get(F.col(c), s)
    shapley = []
    for f in range(len(FILTERS)):
        terms = [F.lit(factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) * (at("n", F.lit(s)) - at("n", F.lit(s | 1 << f)))
                 for s in range(every + 1) if not s >> f & 1]
        shapley.append(sum(terms[1:], terms[0]))
    parts = parts.withColumn("shares", F.array(*shapley))
    steps = parts.withColumn("o", F.explode(_orders())).select("*", "o.*")
    now = F.col("before").bitwiseOR(F.col("bit"))
    lost = lambda c: at(c, F.col("before")) - at(c, now)
    return steps.select(
        "part", "filter_order", "step", at("n", now).alias("kept"), lost("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("bit")) - lost("n")).alias("redundant"),
        (at("n", F.lit(every) - F.col("bit")) - at("n", F.lit(every))).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.get("shares", F.log2("bit").cast("int")).alias("shapley"))


def _sql() -> str:
    letters = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
    return rf"""WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l USING (doc_id)),
  f(c, b) AS (VALUES {letters}),
  o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e
    WHERE a.b | b.b | c.b | d.b | e.b = 31),
  s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
  g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
  r AS (SELECT part, filter_order, step, bit, CAST(sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM g, s GROUP BY part, filter_order, step, bit)
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


SQL = _sql()
