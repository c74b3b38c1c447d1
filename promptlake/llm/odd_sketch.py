"""Near duplicates by MinHash bands, odd sketches and exact confirmation.

A text's set holds the 64-bit hashes of its distinct word shingles. Texts with equal sets are one
class. A class has ``BANDS * ROWS`` MinHash samples: shingles compete for bins in rounds with new
hashes, a bin takes the least of the first round that reaches it, and bins that are still empty after
the last round take the least of all shingles; so two sets agree in a bin with a probability equal to
their similarity, whatever their size. Samples in bands of ``ROWS`` are the buckets in which classes
meet: at a similarity of 0.8 two classes share none with a probability below 1e-11. The samples are
also folded into an odd sketch: each flips one bit, so equal samples cancel out in the XOR of two
sketches and its population count tells how many differ. Candidates whose count lies six deviations
above what the wanted similarity gives are dropped; all others are confirmed on the full sets.

Classes that share a bucket meet in the cell of the bucket's smallest class. A class goes there once,
with its set, however many buckets with that smallest class hold it; a large cell is dealt into
blocks of bounded size, and each pair of blocks is a group of its own. A group is searched where its
sets are: each member's closest candidates first, more of them in every further step, and none that
the links found have connected already. So a group gives no pairs but a forest of confirmed links,
fewer than it has members, and components follow from all groups' links.

Null or wordless text: an empty set, linked with nothing. Fewer words than a shingle: all of them
are the one shingle. Repeated ids: each row has the component of its own set. Null ids: they take no
part in the smallest id of a component unless it holds no other; such a row of an empty set has a
null component and is kept. An empty table gives no rows. Other columns, whatever their names, are
not read by :func:`near_duplicates` and stay in :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptlake.llm.batches import add_columns, broadcast_if_small, is_space, mix, short_batches, span_hashes, text_bytes, word_spans
from promptlake.llm.spread import components, join_spread
from promptlake.session import cut, width

BANDS, ROWS = 50, 4
SAMPLES = BANDS * ROWS
BITS = 512
ROUNDS = 16
BLOCK = 8192  # members of a block, at about the most
HELD = 1 << 21  # shingles of a block, 16 MB, at about the most
FIRST = 8  # candidates of a member that are confirmed first
MOST = 512  # candidates confirmed at once
SLICE = 2048  # texts at once
CELLS = 1 << 21
_R = np.uint64(0x9E3779B97F4A7C15)
_FULL = np.uint64((1 << 64) - 1)
_WORDS = [f"s{i}" for i in range(BITS // 64)]
SCHEMA = f"n_shingles long, d1 long, d2 long, bands array<long>, {', '.join(f'{s} long' for s in _WORDS)}, elements binary"


def _seed(x) -> np.ndarray:
    return mix(np.atleast_1d(np.asarray(x, np.uint64)) * _R + np.uint64(0x51ED270B))


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted in each, and the borders of the texts' sets."""
    buf, offsets = text_bytes(texts)
    starts, ends, text_of = word_spans(is_space(buf), offsets)
    word = span_hashes(buf + np.uint8(32) * ((buf >= 65) & (buf <= 90)), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    count = np.bincount(text_of, minlength=len(texts))
    size = np.minimum(count, shingle)[text_of]  # words in a shingle of this text
    at = np.arange(len(word))
    first = np.concatenate([[0], np.cumsum(count)])[:-1][text_of]
    full = at - first + size <= count[text_of]
    value = _seed(size)
    for k in range(shingle):
        inside = size > k
        value = np.where(inside, mix(value * _R + word[np.minimum(at + k, len(word) - 1)] + np.uint64(1)), value) if len(word) else value
    value, text_of = value[full], text_of[full]
    order = np.lexsort((value, text_of))
    value, text_of = value[order], text_of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])
    value, text_of = value[new], text_of[new]
    return value, np.searchsorted(text_of, np.arange(len(texts) + 1))


def samples(value: np.ndarray, border: np.ndarray) -> np.ndarray:
    """MinHash samples (sets x SAMPLES) of nonempty sets."""
    n = len(border) - 1
    out = np.full((n, SAMPLES), _FULL)
    flat, open_ = out.reshape(-1), np.arange(n)
    for r in range(ROUNDS):
        sizes = np.diff(border)[open_]
        inside = np.repeat(border[open_] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        h = mix(value[inside] ^ _seed(r))
        cell = np.repeat(open_, sizes) * SAMPLES + ((h >> np.uint64(40)) * np.uint64(SAMPLES) >> np.uint64(24)).astype(np.int64)
        fresh = flat[cell] == _FULL  # before this round
        np.minimum.at(flat, cell[fresh], mix(h[fresh] + np.uint64(r)) >> np.uint64(1))
        open_ = open_[(out[open_] == _FULL).any(axis=1)]
        if not len(open_):
            return out
    bins = _seed(np.arange(SAMPLES) + 1000)
    for i in open_.tolist():
        mine = value[border[i]:border[i + 1]]
        for lo in range(0, SAMPLES, step := max(1, CELLS // len(mine))):
            empty = lo + np.flatnonzero(out[i, lo:lo + step] == _FULL)
            if len(empty):
                out[i, empty] = (mix(mine[:, None] ^ bins[None, empty]) >> np.uint64(1)).min(axis=0)
    return out


def fold(found: np.ndarray) -> np.ndarray:
    """Odd sketches (sets x BITS / 64 words) of samples."""
    bit = (mix(found + _seed(np.arange(SAMPLES))[None, :]) % np.uint64(BITS)).astype(np.int64)
    flips = np.bincount((np.arange(len(found))[:, None] * BITS + bit).ravel(), minlength=len(found) * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(len(found), BITS), axis=1, bitorder="little").view(np.int64)


def most_flips(similarity: float) -> int:
    """The largest XOR population count that a pair of ``similarity`` gives, within six deviations of
    the samples and the sketch together."""
    differ = SAMPLES * (1 - similarity)
    even = exp(-4 * differ / BITS)
    odd = (1 - even) / 2
    return int(BITS * odd + 6 * sqrt(SAMPLES * similarity * (1 - similarity) * (2 * even) ** 2 + BITS * odd * (1 - odd)))


def similarity_of(flips: int) -> float:
    """The similarity that an XOR population count speaks for."""
    return max(0.0, 1 + np.log(max(1e-9, 1 - 2 * flips / BITS)) * BITS / (4 * SAMPLES))


def _marks(shingle: int):
    def make(texts: pa.Array) -> dict:
        made: dict[str, list] = {n: [] for n in ("n", "d1", "d2", "bands", "sketch", "elements")}
        for lo in range(0, len(texts), SLICE):
            part = texts.slice(lo, SLICE)
            value, border = shingle_sets(part, shingle)
            sizes = np.diff(border)
            some = np.flatnonzero(sizes)
            n = len(some)
            digests, keys, sketch = np.zeros((2, len(part)), np.uint64), np.zeros((n, BANDS), np.uint64), np.zeros((len(part), BITS // 64), np.int64)
            if n:
                inner = np.concatenate([[0], np.cumsum(sizes[some])])
                for d, salt in zip(digests, (1, 2)):
                    d[some] = mix(np.add.reduceat(mix(value ^ _seed(salt)), inner[:-1]) + sizes[some].astype(np.uint64))
                found = samples(value, inner)
                keys += _seed(np.arange(BANDS) + 5000)
                for r in range(ROWS):
                    keys = mix(keys * _R + found[:, r::ROWS])
                sketch[some] = fold(found)
            made["n"].append(sizes)
            for k, d in zip(("d1", "d2"), digests):
                made[k].append(d.view(np.int64))
            ends = np.cumsum((sizes > 0) * BANDS)
            made["bands"].append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.view(np.int64).ravel())))
            made["sketch"].append(sketch)
            made["elements"].append(pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(border.astype(np.int64) * 8), pa.py_buffer(value)]).cast(pa.binary()))
        words = np.concatenate(made["sketch"]) if made["sketch"] else np.zeros((0, BITS // 64), np.int64)
        join = lambda k: pa.array(np.concatenate(made[k]).astype(np.int64))
        return {"n_shingles": join("n"), "d1": join("d1"), "d2": join("d2"), "bands": pa.concat_arrays(made["bands"]),
                **{s: pa.array(np.ascontiguousarray(words[:, i])) for i, s in enumerate(_WORDS)}, "elements": pa.concat_arrays(made["elements"])}

    return make


def _block(node: Column | str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _block_pair(x: Column | str, y: Column | str) -> Column:
    return F.least(x, y).cast("long") * (1 << 31) + F.greatest(x, y)


def forest(block: np.ndarray, sketch: np.ndarray, border: np.ndarray, value: np.ndarray, flips: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect exactly the members which chains of similar ones connect, none
    twice. Of members of two blocks only those of different ones are held against each other."""
    sizes, root, made = np.diff(border), np.arange(len(block)), []
    two = bool((block != block[0]).any())
    value = np.unique(value, return_inverse=True)[1]
    mine = np.zeros(value.max(initial=0) + 1, bool)  # of all shingles, those of x
    for x in range(len(block) - 1):
        later = slice(x + 1, None)
        ok = (root[later] != root[x]) & (100 * np.minimum(sizes[later], sizes[x]) >= percent * np.maximum(sizes[later], sizes[x]))
        y = x + 1 + np.flatnonzero(ok & (block[later] != block[x]) if two else ok)
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        y = y[np.argsort(apart, kind="stable")[:(apart <= flips).sum()]]
        if not len(y):
            continue
        own, most = value[border[x]:border[x + 1]], FIRST
        mine[own] = True
        while len(y):
            some = y[:most]
            ends = np.cumsum(sizes[some])
            starts = ends - sizes[some]
            inside = np.repeat(border[some] - starts, sizes[some]) + np.arange(ends[-1])
            both = np.add.reduceat(mine[value[inside]], starts, dtype=np.int64)
            for z in some[100 * both >= percent * (sizes[x] + sizes[some] - both)].tolist():
                if root[z] != root[x]:
                    made.append((x, z))
                    root[root == root[z]] = root[x]
            y = y[most:]
            y = y[root[y] != root[x]]
            most = min(8 * most, MOST)
        mine[own] = False
    return made


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """(node, block, sketch, size, shingles) of each group (cell, part) of sorted rows."""
    at, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, part, node, block = (np.asarray(batch[c], np.int64) for c in ("cell", "part", "node", "block"))
        sketch = np.stack([np.asarray(batch[s], np.int64) for s in _WORDS], axis=1).view(np.uint64)
        value, border = text_bytes(batch["elements"])
        value, border = value.view(np.uint64), border // 8
        new = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(node)]):
            if held and at != (cell[lo], part[lo]):
                yield [np.concatenate(x) for x in zip(*held)]
                held = []
            at = cell[lo], part[lo]
            held.append((node[lo:hi], block[lo:hi], sketch[lo:hi], np.diff(border[lo:hi + 1]), value[border[lo]:border[hi]]))
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _search(flips: int, percent: int):
    """Links (a, b) of each group of sorted rows (cell, part, node, block, sketch words, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for node, block, sketch, size, value in _groups(batches):
            made += [(node[x], node[y]) for x, y in forest(block, sketch, np.concatenate([[0], np.cumsum(size)]), value, flips, percent)]
            if len(made) >= SLICE:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["a", "b"])
                made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*made)], ["a", "b"])

    return run


def links(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect exactly the classes which chains of similar ones connect.
    ``classes``: (node, n, bands), ``sets``: (node, sketch words, elements)."""
    spark = classes.sparkSession
    classes = cut(classes)
    listed = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n").alias("held"))
    crowded = listed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("cell")).filter("n > 1")
    members = cut(join_spread(listed, cut(crowded), ["bucket"]).select("cell", "node", "held").distinct())

    cells = cut(members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("held").alias("weight")).withColumn(
        "blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("weight") / HELD)).cast("int")).drop("weight"))
    placed = join_spread(members, cells, ["cell"]).withColumn("block", _block("node", F.col("blocks")))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", _block_pair("block", "other").alias("part"), "node", "block")

    # the sets stay where they are stored; only those of members are moved
    held = cut(sets.join(broadcast_if_small(members.select("node").distinct()), "node"))
    rows = dealt.join(held, "node").repartition(width(spark), "cell", "part").sortWithinPartitions("cell", "part")
    with short_batches(spark):
        return cut(rows.select("cell", "part", "node", "block", *_WORDS, "elements").mapInArrow(
            _search(most_flips(percent / 100), percent), "a long, b long"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``: texts whose sets of ``shingle``
    words are ``percent`` per cent alike or more are linked."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    with short_batches(docs.sparkSession):
        marked = cut(add_columns(rows, "text", SCHEMA, _marks(shingle), keep=False).withColumn("row", F.monotonically_increasing_id()))
    full = marked.filter("n_shingles > 0")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.count("*").alias("copies"), F.min("key").alias("least"), F.min("row").alias("node"))
    classes = cut(classes)
    chosen = full.select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), "bands").join(classes.select("node"), "node", "left_semi")
    pieces = components(links(chosen, full.select(F.col("row").alias("node"), *_WORDS, "elements"), percent))
    rooted = cut(classes.join(pieces, "node", "left").withColumn("root", F.coalesce("root", "node")))
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    named = cut(join_spread(rooted, ids, ["root"]).select("d1", "d2", "n_shingles", "copies", "component_id"))
    told = join_spread(full.select("key", "d1", "d2", "n_shingles"), named, ["d1", "d2", "n_shingles"], "copies")
    alone = marked.filter("n_shingles = 0").select("key", "n_shingles", F.col("key").alias("component_id"))
    out = told.select("key", "n_shingles", "component_id").unionByName(alone)
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns: those of the
    smallest id of each component, and those without an id whose set is empty."""
    kept = near_duplicates(docs, key, text, shingle, percent).filter("kept").select(F.struct(F.col(f"`{key}`").alias("k")).alias("kept")).distinct()
    return docs.join(kept, F.struct(docs[f"`{key}`"].alias("k")) == kept["kept"], "left_semi")


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
  e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
  r AS (SELECT DISTINCT x AS node, x AS reach FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
  c AS (SELECT node, min(reach) AS root FROM r GROUP BY node)
  SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, coalesce(c.root, w.doc_id) = w.doc_id AS kept
  FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id"""
