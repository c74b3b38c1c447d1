"""Nearest neighbours and similar pairs over embedding columns.

Both sides are dealt at random into a few parts, and each part of one side meets each of the other
in a block. A row is sent once for each part of the other side, whose number does not grow with the
table until a part would hold more than ``HELD_ROWS`` rows, so what is shuffled grows with the rows.
Inside a block rows are compared tile by tile, ``block_rows`` of a side at most; only matches leave
a tile, and of those only the best k per query leave a block. Vectors also have a zone: zones that
no pair above the threshold could span are not compared.

Similarities are rounded to six places, so that equal vectors tie and ties break on
(stored time, entry id) instead of on floating-point noise.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.functions.vector import cosine_sim
from promptlake.session import width

BLOCK_ROWS = 16_384
PARTS = 8
HELD_ROWS = 65_536
PLACES = 6
_SIDE = "id string, vec array<float>, at bigint, until bigint, copies bigint"


def _side(df: DataFrame, rid: str, vec: str, at: str | None, until: str | None, copies: Column | None = None) -> DataFrame:
    """Narrow frame of usable vectors: id, vector, life span in microseconds, and how many rows it stands for."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    usable = F.aggregate(
        vec, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double") * x.cast("double"), F.lit(float("nan"))))
    ok = (usable > 0) & ~F.isnan(usable) & (usable < float("inf"))
    return df.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(rid).cast("string").alias("id"), F.col(vec).cast("array<float>").alias("vec"),
        (us(at) if at else F.lit(0).cast("bigint")).alias("at"),
        (us(until) if until else F.lit(2**63 - 1).cast("bigint")).alias("until"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"))


def _matrix(column) -> np.ndarray:
    m = np.vstack(column.to_numpy()).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# --- layout -----------------------------------------------------------------------------


def _pivots(store: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors picked by hash; n is at most a few hundred."""
    rows = store.orderBy(F.xxhash64("id")).select("vec").limit(n).collect()
    m = np.array([r["vec"] for r in rows] or np.zeros((0, 1)), dtype=np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot as ``zone`` and the angle to it."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                sims = _matrix(pdf["vec"]) @ shared.value.T
                zone = sims.argmax(axis=1)
                best = np.clip(sims[np.arange(len(pdf)), zone], -1.0, 1.0)
                yield pdf.assign(zone=zone.astype("int64"), angle=np.arccos(best))

    return df.mapInPandas(assign, _SIDE + ", zone bigint, angle double")


def _meeting_zones(q: DataFrame, s: DataFrame, pivots: np.ndarray, threshold: float) -> np.ndarray:
    """Which zones may hold a pair at or above the threshold (triangle inequality on
    angles). One row per pivot comes to the driver."""
    def radius(d):
        out = np.full(len(pivots), -np.inf)
        for zone, r in d.groupBy("zone").agg(F.max("angle")).collect():
            out[zone] = r
        return out

    gap = np.arccos(np.clip(pivots @ pivots.T, -1.0, 1.0))
    reach = np.arccos(max(-1.0, threshold - 10.0 ** -PLACES)) + 1e-6
    return gap - radius(q)[:, None] - radius(s)[None, :] <= reach


def _blocks(q: DataFrame, s: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Deal the rows of each cell, by hash, into ``parts`` parts a side (fewer if they are few, more
    if one would hold over ``HELD_ROWS``); each part of one side meets each of the other.

    Both sides carry ``cell``; a crowded one is dealt as any other.
    """
    n = F.count(F.lit(1))
    count = F.greatest(F.least(F.ceil(n / 512), F.lit(parts)), F.ceil(n / HELD_ROWS)).cast("int")
    grid = q.groupBy("cell").agg(count.alias("q_parts")).join(s.groupBy("cell").agg(count.alias("s_parts")), "cell")
    grid = F.broadcast(grid) if parts > 1 else grid  # a single row then
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    q = q.join(grid, "cell").withColumn("qp", own("q_parts")).withColumn("sp", every("s_parts"))
    s = s.join(grid, "cell").withColumn("sp", own("s_parts")).withColumn("qp", every("q_parts"))
    return q.drop("q_parts", "s_parts"), s.drop("q_parts", "s_parts")


# --- kernel -----------------------------------------------------------------------------

_RESULT = "qid string, sid string, similarity double, s_at bigint, q_copies bigint, s_copies bigint"
_RESULT_ROWS = 100_000
_SLACK = 1.001 * 10.0 ** -PLACES  # what rounding may move a similarity, on both sides of a comparison


class _Rows:
    """One side of a block as arrays."""

    def __init__(self, table: pa.Table):
        column = lambda c: table[c].combine_chunks()
        vec = column("vec")
        dim = np.unique(pc.list_value_length(vec).to_numpy(zero_copy_only=False))
        if len(dim) > 1:
            raise ValueError(f"vectors of different lengths: {dim.tolist()}")
        m = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        self.m, self.id = m, column("id")
        # an unknown time orders first, as in a sort
        self.at, self.until, self.zone, self.copies = (
            pc.fill_null(column(c), -2**63).to_numpy(zero_copy_only=False) for c in ("at", "until", "zone", "copies"))

    def __len__(self):
        return len(self.m)


def _order(s: _Rows, one_zone: bool) -> np.ndarray:
    """Place of each entry by (stored time, id); the rows of a zone come in that order."""
    place = np.arange(len(s))
    if not one_zone:
        place[pc.sort_indices(pa.table({"at": s.at, "id": s.id}), [("at", "ascending"), ("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(s))
    return place


def _before(q: _Rows, s: _Rows, place: np.ndarray) -> np.ndarray:
    """Per query, how many entries come before it by (time, id)."""
    order = np.empty_like(place)
    order[place] = np.arange(len(place))
    at = s.at[order]
    found, last = np.searchsorted(at, q.at, "left"), np.searchsorted(at, q.at, "right")
    tied = np.flatnonzero(found < last)
    if len(tied):
        known = lambda x: (x is not None, x or "")
        ids = s.id.take(pa.array(order)).to_pylist()
        for i in tied:
            found[i] = bisect_left(ids, known(q.id[int(i)].as_py()), int(found[i]), int(last[i]), key=known)
    return found


def _runs(q: _Rows, s: _Rows, meets: np.ndarray | None):
    """(first, end, entries): runs of queries, and the entries whose zones they meet (None: all)."""
    if meets is None:
        return [(0, len(q), None)]
    near = meets[q.zone][:, np.unique(s.zone)]
    cuts = (np.flatnonzero((near[1:] != near[:-1]).any(axis=1)) + 1).tolist()
    runs = []
    for a, b in zip([0, *cuts], [*cuts, len(q)]):
        met = np.flatnonzero(meets[q.zone[a]][s.zone])
        runs.append((a, b, None if len(met) == len(s) else met))
    return runs


class _Best:
    """The best k of each query of a tile so far: row, entry, place of the entry, similarity."""

    def __init__(self, n: int, k: int, low: float):
        self.k, self.bar, self.last = k, np.full(n, low), np.full(n, 2**62)
        self.open = np.ones(n, dtype=bool)
        self.rows = [np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0)]

    def limit(self, sims: np.ndarray) -> np.ndarray:
        """Per query, the similarity below which nothing can be among the best."""
        if self.k < sims.shape[1] and self.open.any():
            kth = np.partition(sims, -self.k, axis=1)[:, -self.k]
            return np.where(self.open, np.maximum(self.bar, kth), self.bar)
        return self.bar

    def add(self, row, entry, place, sim) -> None:
        better = (sim > self.bar[row]) | ((sim == self.bar[row]) & (place < self.last[row]))
        if not better.any():
            return
        row, entry, place, sim = (np.concatenate((old, new[better])) for old, new in zip(self.rows, (row, entry, place, sim)))
        order = np.lexsort((place, -sim, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        keep = rank < self.k
        self.rows = [row[keep], *(x[order][keep] for x in (entry, place, sim))]
        full = np.flatnonzero(rank[keep] == self.k - 1)
        row, _, place, sim = (x[full] for x in self.rows)
        self.bar[row], self.last[row], self.open[row] = sim, place, False


def _matches(q: _Rows, s: _Rows, k: int | None, low: float, in_time: bool, below_id: bool,
             block_rows: int, meets: np.ndarray | None):
    """Yields (query rows, entry rows, similarities), tile by tile."""
    place = _order(s, meets is None)
    before = _before(q, s, place) if in_time else None
    if below_id:
        q_id, s_id = (pc.cast(x.id, pa.int64()) for x in (q, s))
        # without an id a row has no place in the order
        q_id, s_id = pc.fill_null(q_id, -2**63).to_numpy(), pc.fill_null(s_id, 2**63 - 1).to_numpy()
    height, width_ = min(block_rows, 256), min(block_rows, 8192)
    for first, end, met in _runs(q, s, meets):
        for i in range(first, end, height):
            rows = slice(i, min(i + height, end))
            best = _Best(rows.stop - i, k, low) if k is not None else None
            for j in range(0, len(s) if met is None else len(met), width_):
                cols = slice(j, j + width_) if met is None else met[j:j + width_]
                if in_time and (s.at[cols].min() > q.at[rows].max() or s.until[cols].max() <= q.at[rows].min()):
                    continue
                sims = q.m[rows] @ s.m[cols].T
                if in_time:
                    sims[(place[cols] >= before[rows, None]) | (s.until[cols] <= q.at[rows, None])] = -np.inf
                if below_id:
                    sims[s_id[cols] >= q_id[rows, None]] = -np.inf
                limit = best.limit(sims)[:, None] if best else low
                a, b = np.nonzero(sims >= limit - _SLACK)
                sim = np.round(sims[a, b], PLACES)
                ok = sim >= low
                a, sim, entry = a[ok], sim[ok], (b[ok] + j if met is None else cols[b[ok]])
                if best:
                    best.add(a, entry, place[entry], sim)
                elif len(a):
                    yield a + i, entry, sim
            if best and len(best.rows[0]):
                row, entry, _, sim = best.rows
                yield row + i, entry, sim


def _compare(q: DataFrame, s: DataFrame, k: int | None, threshold: float, in_time: bool,
             below_id: bool, block_rows: int, meets: np.ndarray | None = None) -> DataFrame:
    """Compare the blocks. ``k`` keeps the best k per query; None keeps everything at or
    above the threshold. ``in_time``: the entry was stored before the query and is alive.
    ``below_id``: the entry's id (a number) is below the query's."""
    low, spark, key = float(threshold), q.sparkSession, ["cell", "sp", "qp"]
    shared = spark.sparkContext.broadcast(meets)

    def result(q, s, found):
        row, entry, sim = (np.concatenate(x) for x in zip(*found))
        ids = lambda x, at: x.id.take(pa.array(at))
        return pa.RecordBatch.from_arrays(
            [ids(q, row), ids(s, entry), pa.array(sim), pa.array(s.at[entry]), pa.array(q.copies[row]), pa.array(s.copies[entry])],
            ["qid", "sid", "similarity", "s_at", "q_copies", "s_copies"])

    def block(parts):
        table = pa.Table.from_batches(parts)
        parts.clear()
        n = int(pc.sum(table["is_q"]).as_py())
        if not 0 < n < len(table):
            return
        q, s = _Rows(table.slice(0, n)), _Rows(table.slice(n))
        del table
        found, size = [], 0
        for match in _matches(q, s, k, low, in_time, below_id, block_rows, shared.value):
            found.append(match)
            size += len(match[0])
            if size >= _RESULT_ROWS:
                yield result(q, s, found)
                found, size = [], 0
        if found:
            yield result(q, s, found)

    def compare(batches):
        now, parts = None, []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in key])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if a == b:
                    continue
                if now != tuple(keys[:, a]):
                    if parts:
                        yield from block(parts)
                    now, parts = tuple(keys[:, a]), []
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from block(parts)

    both = q.withColumn("is_q", F.lit(True)).unionByName(s.withColumn("is_q", F.lit(False)))
    # blocks are small in bytes and large in arithmetic: keep them spread out
    dealt = both.repartition(width(spark), *key)
    return dealt.sortWithinPartitions(*key, F.desc("is_q"), "zone", "at", "id").mapInArrow(compare, _RESULT)


def rank_candidates(found: DataFrame, k: int | None) -> DataFrame:
    """Rank per query: best similarity first, ties to the oldest entry."""
    w = Window.partitionBy("qid").orderBy(F.desc("similarity"), "s_at", "sid")
    ranked = found.withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= k) if k else ranked


def _merge(found: DataFrame, k: int) -> DataFrame:
    return rank_candidates(found, k).select("qid", "rank", "sid", "similarity")


def _layout(q: DataFrame, s: DataFrame, threshold: float, pivots: int | None, block_rows: int):
    """Both sides in blocks, and which zones meet."""
    if threshold <= -1:
        pivots = 0  # all zones would meet
    elif pivots is None:
        pivots = min(256, s.count() // (4 * block_rows))
    zero, meets = F.lit(0).cast("bigint"), None
    if pivots < 2:
        q, s = q.withColumn("zone", zero), s.withColumn("zone", zero)
    else:
        centres = _pivots(s, pivots)
        q, s = _assign(q, centres), _assign(s, centres)
        meets = _meeting_zones(q, s, centres, threshold)
        q, s = q.drop("angle"), s.drop("angle")
    return *_blocks(q.withColumn("cell", zero), s.withColumn("cell", zero), PARTS), meets


# --- operators --------------------------------------------------------------------------


def knn(queries: DataFrame, store: DataFrame, k: int = 3, threshold: float = -1.0,
        qid: str = "request_id", sid: str = "entry_id", q_vec: str = "embedding",
        s_vec: str = "embedding", q_at: str | None = None, s_at: str | None = None,
        s_until: str | None = None, pivots: int | None = None,
        block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest entries per query: (qid, rank, sid, similarity).

    With ``q_at``, ``s_at`` and ``s_until`` only entries alive at the query's time count.
    A threshold gives the same rows as filtering the result afterwards, and prunes cells.
    """
    in_time = q_at is not None
    q = _side(queries, qid, q_vec, q_at, None)
    s = _side(store, sid, s_vec, s_at, s_until)
    if in_time:  # what has no time is never before anything, nor alive
        q, s = q.filter("at IS NOT NULL"), s.filter("at IS NOT NULL AND until IS NOT NULL")
    else:
        # of equal vectors only the k oldest can be among the best k
        same = Window.partitionBy("vec").orderBy("at", "id")
        s = s.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k).drop("_n")
    q, s, meets = _layout(q, s, threshold, pivots, block_rows)
    return _merge(_compare(q, s, k, threshold, in_time, False, block_rows, meets), k)


def above(queries: DataFrame, store: DataFrame, threshold: float, qid: str = "request_id", sid: str = "entry_id",
          q_vec: str = "embedding", s_vec: str = "embedding", pivots: int | None = None,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every entry at or above the threshold, however many a query has: (qid, sid, similarity, s_at)."""
    q, s, meets = _layout(_side(queries, qid, q_vec, None, None), _side(store, sid, s_vec, None, None), threshold, pivots, block_rows)
    return _compare(q, s, None, threshold, False, False, block_rows, meets).select("qid", "sid", "similarity", "s_at")


def _distinct_vectors(df: DataFrame, rid: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct vector under its smallest id, members of each)."""
    d = df.select(F.col(rid).cast("bigint").alias("id"), F.col(vec).alias("vec"))
    reps = d.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return reps, d.join(reps, "vec").select("id", "rep")


def copies(df: DataFrame, rid: str = "id", vec: str = "embedding") -> DataFrame:
    """Members of each group of equal vectors: (id, rep)."""
    return _distinct_vectors(df, rid, vec)[1]


def similar_pairs(df: DataFrame, threshold: float, rid: str = "id", vec: str = "embedding",
                  pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs i > j of distinct vectors with similarity >= threshold, with the number of copies
    on each side. Equal vectors stand in for each other (see :func:`copies`), so a large
    group of copies does not become a quadratic number of rows."""
    reps, _ = _distinct_vectors(df, rid, vec)
    side = _side(reps, "rep", "vec", None, None, F.col("copies"))
    q, s, meets = _layout(side, side, threshold, pivots, block_rows)
    # the numbers of copies go with the vectors: pairs, which are many, are not joined again
    pairs = _compare(q, s, None, threshold, False, True, block_rows, meets)
    return pairs.select(
        F.col("qid").cast("bigint").alias("i"), F.col("sid").cast("bigint").alias("j"), "similarity",
        F.col("q_copies").alias("i_copies"), F.col("s_copies").alias("j_copies"))


def every_similar_pair(df: DataFrame, threshold: float, rid: str = "id", vec: str = "embedding",
                       pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs i > j of rows with similarity >= threshold, copies among them: (i, j, similarity).

    Rows that repeat an id make pairs of their own, but none with each other; rows without an id
    make none. Groups of copies are dealt over the blocks like other rows; the pairs inside one
    are part of the result and grow with its square."""
    d = df.select(F.col(rid).cast("bigint").alias("id"), F.col(vec).alias("vec")).filter("id IS NOT NULL")
    side = _side(d, "id", "vec", None, None)
    q, s, meets = _layout(side, side, threshold, pivots, block_rows)
    pairs = _compare(q, s, None, threshold, False, True, block_rows, meets)
    return pairs.select(F.col("qid").cast("bigint").alias("i"), F.col("sid").cast("bigint").alias("j"), "similarity")


def similarity_matrix(df: DataFrame, floor: float, rid: str = "id", vec: str = "embedding",
                      pivots: int | None = None) -> DataFrame:
    """Both triangles and the diagonal (1.0) of the similarity matrix over distinct vectors, as
    (i, j, similarity at four places). Cells below ``floor`` are left out: a full matrix has
    quadratically many."""
    half = similar_pairs(df, floor, rid, vec, pivots).select("i", "j", "similarity")
    reps, _ = _distinct_vectors(df, rid, vec)
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return (
        half.select(both.alias("c"), "similarity").select("c.i", "c.j", F.bround("similarity", 4).alias("similarity"))
        .unionByName(reps.select(F.col("rep").alias("i"), F.col("rep").alias("j"), F.lit(1.0).alias("similarity"))))


def _signatures(df: DataFrame, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per hash table; ``cell`` holds the table and the sign pattern."""
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dim))
    weights = (1 << np.arange(bits)).astype("int64")

    def sign(batches):
        for pdf in batches:
            if len(pdf):
                side = (_matrix(pdf["vec"]) @ planes.T >= 0).reshape(len(pdf), tables, bits)
                cells = side @ weights + (np.arange(tables, dtype="int64") << bits)
                yield pdf.assign(cell=list(cells))

    return df.mapInPandas(sign, _SIDE + ", cell array<bigint>").withColumn("cell", F.explode("cell")).withColumn(
        "zone", F.lit(0).cast("bigint"))


def knn_lsh(queries: DataFrame, store: DataFrame, k: int = 3, dim: int = 384, tables: int = 8,
            bits: int = 12, threshold: float = -1.0, qid: str = "request_id", sid: str = "entry_id",
            q_vec: str = "embedding", s_vec: str = "embedding", seed: int = 17,
            block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate neighbours: rows meet where their signatures agree in some table, and meet
    in bounded blocks, so a crowded signature only means more blocks."""
    q = _signatures(_side(queries, qid, q_vec, None, None), dim, tables, bits, seed)
    s = _signatures(_side(store, sid, s_vec, None, None), dim, tables, bits, seed)
    q, s = _blocks(q, s, 1)
    found = _compare(q, s, k, threshold, False, False, block_rows).dropDuplicates(["qid", "sid"])
    return _merge(found, k)


def recall_vs_exact(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours that the approximate search found."""
    found = approximate.select("qid", "sid", F.lit(1).alias("found"))
    return exact.join(found, ["qid", "sid"], "left").agg(
        F.count(F.lit(1)).alias("expected"), F.count("found").alias("found"),
        F.round(F.count("found") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).alias("recall"))


def pair_similarity(pairs: DataFrame, emb_raw: DataFrame, emb_norm: DataFrame, rid: str = "id",
                    vec: str = "embedding", threshold: float = 0.75) -> DataFrame:
    """Similarity of given pairs (a, b) before and after normalization."""
    out = pairs
    for name, emb in (("before", emb_raw), ("after", emb_norm)):
        for end in ("a", "b"):
            out = out.join(emb.select(F.col(rid).alias(end), F.col(vec).alias(f"_{end}")), end, "left")
        out = out.withColumn(f"sim_{name}", cosine_sim("_a", "_b")).drop("_a", "_b")
    return out.withColumns({
        "sim_delta": F.bround(F.col("sim_after") - F.col("sim_before"), 4),
        "passes": F.col("sim_after") >= threshold,
        "sim_before": F.bround("sim_before", 4),
        "sim_after": F.bround("sim_after", 4),
    })


