"""Near duplicates by 64-bit SimHash, found through an inverted index on byte positions.

Fingerprints within ``radius`` bits agree in at least ``8 - radius`` of their eight positional
bytes. Posting lists of single bytes grow with the square of the corpus, so the index lists each
distinct fingerprint under every set of ``8 - radius`` positions with the bytes found there: two
fingerprints meet exactly if they reach that minimum of shared bytes. Inside a list the shared
positional bytes are tallied per pair, pairs at the minimum are verified by their differing bits,
and only a star of links per connected piece leaves the task. Long lists are cut into blocks by
hash and every two blocks meet, so no task holds a whole list. Components follow from alternating
large and small stars over the links; each round is written to the shared folder.

Null or wordless text: fingerprint zero, linked like any other. Repeated ids: the row's component
is that of its own fingerprint. Null ids: they take no part in the smallest id of a component
unless it holds no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from promptlake.llm.batches import add_columns
from promptlake.session import cut, width

BLOCK = 1024
PAIRS = 1 << 21
FEW_LISTS = 1 << 17


def fingerprints(texts: list[str | None], shingle: int) -> np.ndarray:
    """SimHash of each text's word shingles, as signed 64-bit numbers."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        data = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = max(1, len(words) - shingle + 1)
        last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
        hashes += [digest(data[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())]
        counts[i] = n
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full) == 0:
        return out.view(np.int64)
    every = np.array(hashes, np.uint64)
    borders = np.concatenate([[0], np.cumsum(counts[full])])
    step = 1 << 16
    ones = np.zeros((len(full), 64), np.int64)
    for lo in range(0, len(every), step):
        hi = min(lo + step, len(every))
        bits = np.unpackbits(every[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        a, b = np.searchsorted(borders, lo, "right") - 1, np.searchsorted(borders, hi, "left")
        cuts = np.maximum(borders[a:b], lo) - lo
        ones[a:b] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    set_bits = (2 * ones > counts[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, into: str = "fp") -> DataFrame:
    return add_columns(docs, text, f"`{into}` long", lambda t: {into: fingerprints(t.to_pylist(), shingle)})


def _stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) for the connected pieces of one posting list's block pair."""
    n = len(values)
    by_byte = values.view(np.uint8).reshape(n, 8)
    root = np.arange(n)
    step = max(1, PAIRS // n)
    for lo in range(0, n, step):
        a = slice(lo, min(lo + step, n))
        tally = (by_byte[a, None, :] == by_byte[None, :, :]).sum(axis=2, dtype=np.uint8)
        x, y = np.nonzero(tally >= 8 - radius)
        x += lo
        ok = x > y
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(values[x] ^ values[y]) <= radius
        x, y = x[ok], y[ok]
        while True:  # hook the larger root to the smaller, then shorten
            p, q = root[x], root[y]
            open_ = p != q
            if not open_.any():
                break
            x, y, p, q = x[open_], y[open_], p[open_], q[open_]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(root, root[root]):
                root = root[root]
    member = np.flatnonzero(root != np.arange(n))
    return values[member], values[root[member]]


def _pairs_small(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of many short posting lists at once."""
    left = np.repeat(np.arange(len(values)), np.repeat(sizes, sizes))
    first = np.repeat(np.repeat(starts, sizes), np.repeat(sizes, sizes))
    width_of = np.repeat(sizes, sizes)
    base = np.repeat(np.cumsum(width_of) - width_of, width_of)
    right = first + np.arange(len(left)) - base
    ok = left > right
    a, b = values[left[ok]], values[right[ok]]
    tally = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1)
    ok = tally >= 8 - radius
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(a ^ b) <= radius
    return a[ok], b[ok]


def _verify(radius: int):
    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows cut at the ends of posting lists."""
        rest = None
        for batch in batches:
            now = [np.asarray(batch.column(i), np.int64) for i in range(3)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            key, pair, value = now
            if not len(key):
                continue
            new = np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1
            at = int(new[-1]) if len(new) else 0
            if at:
                yield key[:at], pair[:at], value[:at]
            rest = [x[at:] for x in now]
        if rest is not None and len(rest[0]):
            yield tuple(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pair, value in lists(batches):
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(key)))
            values = np.ascontiguousarray(value).view(np.uint64)
            found = []
            small = sizes <= 16
            member = np.repeat(small, sizes)
            if member.any():
                s = sizes[small]
                found.append(_pairs_small(values[member], np.cumsum(s) - s, s, radius))
            for a, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
                found.append(_stars(values[a:a + n], radius))
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` that chains of steps of at
    most ``radius`` bits connect."""
    spark = fps.sparkSession
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    sets = list(combinations(range(8), 8 - radius))
    masks = [signed(sum(0xFF << (8 * p) for p in chosen)) for chosen in sets]
    # a posting list is known by its positions and by the fingerprint with all other bytes cleared
    # few bytes, much work: spread by a fixed number, which adaptive coalescing leaves alone, and by a
    # hash of our own, as a partitioning by fp that is there already would take the place of this one
    listed = fps.select("fp").repartition(width(spark), F.xxhash64("fp")).select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("part", "bytes"))
    crowded = cut(listed.groupBy("part", "bytes").agg(F.count("*").alias("n")).filter("n > 1"))
    # Spark sizes what was exploded as if no row had been added: the join is chosen by a count instead
    crowded = F.broadcast(crowded) if crowded.limit(FEW_LISTS + 1).count() <= FEW_LISTS else crowded.hint("merge")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = (
        listed.join(crowded, ["part", "bytes"]).withColumn("blocks", blocks).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(F.xxhash64("part", "bytes").alias("key"),
                (F.least("mine", "other").cast("long") * (1 << 32) + F.greatest("mine", "other")).alias("pair"), "fp"))
    dealt = dealt.repartition(width(spark), "key", "pair").sortWithinPartitions("key", "pair")
    return dealt.mapInArrow(_verify(radius), "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Alternating large and small stars; the stars' centres are pre-aggregated before any shuffle.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``."""
    marked = cut(with_fingerprint(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text", shingle).drop("text"))
    classes = marked.groupBy("fp").agg(F.min("key").alias("least"))
    pieces = components(links(classes.select("fp"), radius))
    # these have up to a row a document, and far fewer bytes as files than in the driver's memory: none is broadcast
    rooted = cut(classes.join(pieces.hint("merge"), classes["fp"] == pieces["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp", "left").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest, with all their columns; of rows
    that repeat an id one stays. Rows without an id stay: nothing could name them as copies."""
    found = near_duplicates(docs, key, text, shingle, radius)
    kept = found.filter(F.col(f"`{key}`") == F.col("component_id")).select(F.col("component_id").alias("__kept")).distinct()
    rows = docs.join(kept, docs[f"`{key}`"] == kept["__kept"], "left_semi").dropDuplicates([key])
    return rows.unionByName(docs.filter(F.col(f"`{key}`").isNull()))
