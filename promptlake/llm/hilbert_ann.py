"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors get one coordinate more, so that the largest inner product is the nearest neighbour; several
seeded projections to a few dimensions, each shifted, are laid along a Hilbert curve. Each ordering
is range-partitioned into windows of like numbers of rows; a query meets the rows of its own window
and of its neighbours, in every ordering, and the best of all are merged by their exact products. Where
those hold fewer than ``k`` other rows, the run of windows is widened until it does or has them all.
Crowded windows (many equal vectors) are dealt into parts by hash, so that a task holds at most
``PART`` rows and as many queries; all rows of a window are met, none is capped.

Null, zero, empty or non-finite vectors take no part, nor do vectors of another length than the
commonest. Rows without an id take no part. A repeated id counts once, with its best product. Ties
go to the smaller id. Windows are shares of the table: for vectors without any structure the work
grows with queries times rows; for clustered ones raise ``windows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from promptlake.session import cut

PART = 4096


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row of small whole numbers along the Hilbert curve of that many dimensions.

    Walks the bits from the highest: each cell's orthant is ranked by Gray code, then the cell is
    turned into the frame of the orthant's own curve (a swap of two axes and a mirroring).
    """
    n, d = cells.shape
    one = np.int64(1)
    entry = np.zeros(n, np.int64)
    turn = np.zeros(n, np.int64)
    mask = (one << d) - 1
    key = np.zeros(n, np.int64)

    def left(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return ((x << r) | (x >> (d - r))) & mask

    def right(x: np.ndarray, r: np.ndarray) -> np.ndarray:
        return ((x >> r) | (x << (d - r))) & mask

    for b in range(bits - 1, -1, -1):
        orthant = np.zeros(n, np.int64)
        for i in range(d):
            orthant |= ((cells[:, i] >> b) & 1) << i
        gray = right(orthant ^ entry, (turn + 1) % d)
        rank = gray.copy()
        for s in range(1, d):
            rank ^= gray >> s
        key = (key << d) | rank
        even = 2 * ((rank - 1) // 2)
        corner = np.where(rank == 0, 0, even ^ (even >> 1))
        entry = entry ^ left(corner, (turn + 1) % d)
        odd = np.where(rank % 2 == 0, rank - 1, rank)
        ones = np.zeros(n, np.int64)
        run = np.ones(n, bool)
        for i in range(d):
            run &= ((odd >> i) & 1) == 1
            ones += run
        turn = (turn + np.where(rank == 0, 0, ones % d) + 1) % d
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _keys(dim: int, curves: int, dims: int, bits: int, spread: float, top: float, seed: int):
    rng = np.random.default_rng(seed)
    axes = [np.linalg.qr(rng.normal(size=(dim + 1, min(dims, dim + 1))))[0] for _ in range(curves)]
    shifts = rng.uniform(-0.5, 0.5, size=(curves, min(dims, dim + 1)))

    def keys(x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        wide = np.concatenate([x, extra[:, None]], axis=1)
        out = np.empty((len(x), curves), np.int64)
        for c in range(curves):
            place = ((wide @ axes[c]) / spread + shifts[c]) / 8.0 + 0.5
            cells = np.clip(place * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            out[:, c] = hilbert(cells, bits)
        return out

    def add(as_query: bool, held: StructType):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    x = _matrix(batch["vec"])
                    rest = np.zeros(len(x)) if as_query else np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
                    k = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * curves + 1, curves, dtype=np.int32)), pa.array(keys(x, rest).ravel()))
                    yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], k], held.names)

        return run

    return add


def _best(k: int):
    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            q, x = _matrix(left["vec"].combine_chunks()), _matrix(right["vec"].combine_chunks())
            qi, xi = np.asarray(left["id"], np.int64), np.asarray(right["id"], np.int64)
            for lo in range(0, len(q), 256):
                product = q[lo:lo + 256] @ x.T
                product[qi[lo:lo + 256, None] == xi[None, :]] = -np.inf
                most = min(k, len(xi))
                least = np.partition(product, len(xi) - most, axis=1)[:, len(xi) - most]
                slack = 1e-9 * np.abs(least) + 1e-12
                for r in range(len(product)):
                    at = np.flatnonzero(product[r] >= (least[r] - slack[r] if np.isfinite(least[r]) else -np.finfo(float).max))
                    exact = (x[at] * q[lo + r]).sum(axis=1)
                    by = np.lexsort((xi[at], -exact))[:k]
                    out.append((np.full(len(by), qi[lo + r]), xi[at][by], exact[by]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    return run


def _runs(dealt: DataFrame, curves: int, windows: int, reach: int, k: int) -> list[list[tuple[int, int]]]:
    """First and last window that a query in each window of each ordering meets: its own and ``reach``
    on either side, widened outwards until they hold at least ``k`` other ids, or all there are."""
    rows = dealt.groupBy("curve", "win").agg(F.countDistinct("id").alias("n")).collect()
    n = [[0] * windows for _ in range(curves)]
    for r in rows:
        n[r["curve"]][r["win"]] = r["n"]
    ids = dealt.filter("curve = 0").agg(F.countDistinct("id")).first()[0]
    out = []
    for held in n:
        need = k + 1 + sum(held) - ids  # itself, and ids that repeat in several windows
        out.append([])
        for w in range(windows):
            low = max(0, min(w - reach, windows - 1 - 2 * reach))
            high = min(low + 2 * reach, windows - 1)
            while sum(held[low:high + 1]) < need and (low > 0 or high < windows - 1):
                low, high = max(0, low - 1), min(windows - 1, high + 1)
            out[-1].append((low, high))
    return out


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, curves: int = 8,
           dims: int = 3, bits: int = 8, windows: int = 16, reach: int = 1, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``queries`` holds."""
    spark = vectors.sparkSession
    vec = F.col(f"`{vector}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = (F.size(vec) > 0) & F.forall(vec, finite) & F.exists(vec, lambda x: x != 0)
    rows = vectors.filter(F.col(f"`{key}`").isNotNull() & vec.isNotNull()).filter(good).select(
        F.col(f"`{key}`").cast("long").alias("id"), vec.alias("vec"), queries.alias("asks"))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    lengths = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(norm).alias("top"), F.avg(norm).alias("mean"))
    shape = lengths.orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not shape:
        return spark.createDataFrame([], schema)
    dim, top = shape[0]["dim"], float(np.sqrt(shape[0]["top"]))
    rows = rows.filter(F.size("vec") == dim)
    held = StructType([StructField("id", LongType()), rows.schema["vec"], StructField("keys", ArrayType(LongType()))])
    add = _keys(dim, curves, dims, bits, float(np.sqrt(shape[0]["mean"] / dim)) or 1.0, top, seed)
    stored = cut(rows.select("id", "vec").mapInArrow(add(False, held), held))
    asked = rows.filter("asks").select("id", "vec").mapInArrow(add(True, held), held)
    edges = stored.agg(*[F.percentile_approx(F.get("keys", F.lit(c)), [i / windows for i in range(1, windows)], 10_000).alias(f"c{c}") for c in range(curves)]).first()
    edges = [list(e or []) for e in edges]

    def window(c: Column, place: Column) -> Column:
        table = F.array(*[F.array(*[F.lit(int(e)) for e in x]).cast("array<long>") for x in edges])
        return F.size(F.filter(F.get(table, c), lambda e: e <= place))

    dealt = stored.select("id", "vec", F.posexplode("keys").alias("curve", "at")).withColumn("win", window(F.col("curve"), F.col("at"))).drop("at")
    meets = asked.select("id", "vec", F.posexplode("keys").alias("curve", "at")).withColumn("mid", window(F.col("curve"), F.col("at"))).drop("at")
    runs = _runs(dealt, curves, windows, reach, k)
    ends = lambda i: F.get(F.get(F.array(*[F.array(*[F.lit(run[i]) for run in of]) for of in runs]), F.col("curve")), F.col("mid"))
    meets = meets.withColumn("win", F.explode(F.sequence(ends(0), ends(1)))).drop("mid")

    def parts(df: DataFrame) -> Column:
        """How many parts each window is dealt into; the table has curves x windows numbers."""
        n = {(r["curve"], r["win"]): -(-r["n"] // PART) for r in df.groupBy("curve", "win").agg(F.count("*").alias("n")).collect()}
        table = F.array(*[F.array(*[F.lit(n.get((c, w), 1)) for w in range(windows)]) for c in range(curves)])
        return F.get(F.get(table, F.col("curve")), F.col("win"))

    row_parts, ask_parts = parts(dealt), parts(meets)
    mine = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    dealt = dealt.withColumn("p", mine(row_parts)).withColumn("q", all_of(ask_parts))
    meets = meets.withColumn("q", mine(ask_parts)).withColumn("p", all_of(row_parts))
    group = ["curve", "win", "p", "q"]
    found = meets.groupBy(*group).cogroup(dealt.groupBy(*group)).applyInArrow(_best(k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact neighbours (query_id, vec_id) that were found."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count("*").alias("n"))
