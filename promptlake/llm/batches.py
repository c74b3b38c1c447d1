"""Helpers for Arrow batches of texts: bounded chunks, word spans and word hashes in numpy.

A word is a run of bytes other than space and \\x09-\\x0D. Memory follows the chunk (about two
megabytes, or one text if that is longer), never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

CHUNK = 1 << 21
_R = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have about ``size`` bytes together (always at least one row)."""
    n = len(texts)
    if n == 0:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    lo, done = 0, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, done + size, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and each text's offset in them; null counts as empty."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = b"".join(x for x in texts.cast(pa.large_binary()).to_pylist() if x)
    return np.frombuffer(data, np.uint8), offsets


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0-U+00DE."""
    out = buf + np.uint8(32) * ((buf >= 65) & (buf <= 90))
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    out += np.uint8(32) * (after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97))
    return out


def letter_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with a blank for every byte outside letters and non-ASCII characters, the
    spans of the runs left, and the text of each. A blank stands before, between and after texts."""
    data = b"\n".join([b"", *(x or b"" for x in texts.cast(pa.large_binary()).to_pylist()), b""])
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    buf = lower(np.frombuffer(data, np.uint8))
    gap = ~(((buf >= 97) & (buf <= 122)) | (buf >= 128))
    buf[gap] = 32
    starts, ends, text_of = word_spans(gap, offsets)
    return buf, starts, ends, np.minimum(text_of, len(texts) - 1)


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_spans(gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run outside ``gap``, cut at the texts' borders, and its text's index."""
    n = len(gap)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    left, right = np.ones(n, bool), np.ones(n, bool)
    left[1:] = gap[:-1]
    right[:-1] = gap[1:]
    starts = np.flatnonzero(~gap & (left | border[:-1]))
    ends = np.flatnonzero(~gap & (right | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _R), np.full(size, np.uint64(pow(int(_R), -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes (the same bytes give the same hash anywhere)."""
    up, down = _powers(len(buf))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up)])
    return mix((sums[ends] - sums[starts]) * down[starts])


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1024) -> Iterator[None]:
    """Fewer rows in a batch for Python while jobs with long rows run. Other jobs of the session that
    are planned meanwhile have shorter batches too, which changes no result."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def add_columns(docs: DataFrame, text: str, schema: str, make: Callable[[pa.Array], dict], keep: bool = True) -> DataFrame:
    """``docs`` with the columns of ``schema``, which ``make`` gives for each chunk of texts, and
    without the text itself if ``keep`` is false.

    Columns of ``docs`` with such names are replaced; all others are carried along under names of
    our own, so that none can clash.
    """
    made = StructType.fromDDL(schema)
    new = {c.lower() for c in made.names}
    rest = [c for c in docs.columns if c.lower() not in new and c != text]
    keep_text = keep and text.lower() not in new
    held = [f"c{i}" for i in range(len(rest))]
    packed = docs.select(
        F.col(f"`{text}`").cast("string").alias("t"),
        F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(h) for c, h in zip(rest, held)]).alias("r"))
    out = StructType([*packed.schema.fields[0 if keep_text else 1:], *[f for f in made.fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                columns = make(part.column(0))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[0 if keep_text else 1:], *(c if isinstance(c := columns[n], pa.Array) else pa.array(c) for n in made.names)],
                    out.names)

    result = packed.mapInArrow(run, out)
    names = [c for c in docs.columns if c in rest or (keep_text and c == text)]
    return result.select(
        *[F.col("t").alias(c) if c == text else F.col(f"r.{held[rest.index(c)]}").alias(c) for c in names],
        *[F.col(f"`{n}`") for n in made.names])


def broadcast_if_small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows, measured, take at most ``most`` bytes as text."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df
