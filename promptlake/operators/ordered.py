"""Ordered operators that keep one hot key from filling one task.

A plain window over a key puts all of the key's rows into one task. The operators here cut
each key into buckets along the order, aggregate per bucket (combining before the shuffle),
carry the result over the short list of buckets, and run the row window inside a bucket.

The explicit ``repartition`` on (key, bucket) matters: data that already is partitioned by the
key alone would satisfy the window, and the hot key would stay in its one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T


def time_bucket(ts: str, seconds: int) -> Column:
    """Number of the ``seconds`` wide bucket a timestamp falls into."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which null equals null; the keys appear once."""
    other = right.select(*[F.col(c).alias(f"_same_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(other, same).drop(*[f"_same_{k}" for k in keys])


def _all_before(keys, bucket):
    return Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(df: DataFrame, value: Column, keys: list[str], order: list[str], bucket: Column,
                out: str, inclusive: bool = True) -> DataFrame:
    """Prefix sum of ``value`` per key. ``bucket`` must not decrease along ``order``."""
    d = df.withColumn("_b", bucket).withColumn("_v", value)
    before = (
        d.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
        .select(*keys, "_b",
                F.coalesce(F.sum("_t").over(_all_before(keys, "_b")), F.lit(0)).alias("_off")))
    w = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        join_null_safe(d, before, [*keys, "_b"]).repartition(*keys, "_b")
        .withColumn(out, F.col("_off") + F.coalesce(F.sum("_v").over(w), F.lit(0)))
        .drop("_b", "_v", "_off"))


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                  right_tie: str, payload: list[str], bucket_s: int = 3600) -> DataFrame:
    """As-of join: for every left row the last right row of its key with ``right_ts <= left_ts``.

    Both sides are merged per (key, bucket); what was latest when a bucket opened is carried
    in as one more row. Adds ``payload`` columns of the right side, null without a match.
    """
    entry = F.struct(F.col(right_ts).alias("_rts"), F.col(right_tie).alias("_rtie"),
                     *[F.col(p) for p in payload])
    r = right.select(*keys, time_bucket(right_ts, bucket_s).alias("_b"), entry.alias("_e"))
    last_of_bucket = r.groupBy(*keys, "_b").agg(F.max_by("_e", F.struct("_e._rts", "_e._rtie")).alias("_e"))
    opened = (
        left.select(*keys, time_bucket(left_ts, bucket_s).alias("_b")).distinct()
        .join(last_of_bucket, [*keys, "_b"], "full_outer")
        .select(*keys, "_b", F.last("_e", True).over(_all_before(keys, "_b")).alias("_e"))
        .filter(F.col("_e").isNotNull()))
    row = F.struct(*[F.col(c) for c in left.columns])
    merged = (
        left.select(*keys, time_bucket(left_ts, bucket_s).alias("_b"),
                    F.col(left_ts).alias("_t"), F.lit(2).alias("_kind"), row.alias("_l"))
        .unionByName(r.select(*keys, "_b", F.col("_e._rts").alias("_t"), F.lit(1).alias("_kind"), "_e"),
                     allowMissingColumns=True)
        .unionByName(opened.select(*keys, "_b", F.lit(None).cast(left.schema[left_ts].dataType).alias("_t"),
                                   F.lit(0).alias("_kind"), "_e"),
                     allowMissingColumns=True))
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col("_t").asc_nulls_first(), "_kind", "_e._rtie")
         .rowsBetween(Window.unboundedPreceding, 0))
    return (
        merged.repartition(*keys, "_b").withColumn("_hit", F.last("_e", True).over(w))
        .filter(F.col("_kind") == 2)
        .select("_l.*", *[F.col("_hit")[p].alias(p) for p in payload]))


def trailing_mean(df: DataFrame, value: str, keys: list[str], order: list[str], bucket: Column,
                  sizes: dict[str, int], number: Column | None = None, chunk: int = 4096) -> DataFrame:
    """Mean over the last n rows per key, for several n; shorter at the start.

    Rows are numbered by :func:`running_sum`, unless ``number`` already counts them without
    gaps; each chunk of numbers is averaged on its own, with the rows just before it repeated
    as context.
    """
    longest = max(sizes.values())
    if longest > chunk:
        raise ValueError("window is longer than a chunk")
    n = df.withColumn("_n", number) if number is not None else running_sum(
        df, F.lit(1), keys, order, bucket, "_n")
    home = F.floor((F.col("_n") - 1) / chunk).cast("bigint")
    into_next = (F.col("_n") - 1) % chunk >= chunk - (longest - 1)
    spread = n.withColumn("_home", home).withColumn(
        "_c", F.explode(F.when(into_next, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    spread = spread.repartition(*keys, "_c")
    w = Window.partitionBy(*keys, "_c").orderBy("_n")
    exact = isinstance(df.schema[value].dataType, T.IntegralType)
    if exact:
        upto = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
        spread = spread.withColumns({"_p": upto, "_r": F.row_number().over(w)})
    for name, size in sizes.items():
        mean = (
            # whole numbers: a difference of prefix sums, not a new sum per row
            (F.col("_p") - F.coalesce(F.lag("_p", size).over(w), F.lit(0))) / F.least(F.col("_r"), F.lit(size))
            if exact else F.avg(value).over(w.rowsBetween(-(size - 1), 0)))
        spread = spread.withColumn(name, mean)
    return spread.filter(F.col("_c") == F.col("_home")).drop("_n", "_home", "_c", "_p", "_r")


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """Exact order statistics per group: ``ranks`` gives 0-based ranks as expressions of ``n``.

    Equal values are counted before the shuffle. The rank is first located in a coarse
    log-scaled bucket of the counts (mirrored below zero), and only that bucket is sorted.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c")).withColumn(
        "_b", F.floor(F.signum(F.col("_x")) * F.log1p(F.abs(F.col("_x"))) * 2000).cast("bigint"))
    buckets = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_c"))
    everything = Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.array(*[
        F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
        for name, rank in ranks.items()])
    located = (
        buckets.withColumn("n", F.sum("_c").over(everything))
        .withColumn("_before", F.coalesce(F.sum("_c").over(_all_before(by, "_b")), F.lit(0)))
        .withColumn("_w", F.filter(
            wanted,
            lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_before") + F.col("_c"))))
        .filter(F.size("_w") > 0)
        .select(*by, "_b", "n", "_before", "_w"))
    inside = Window.partitionBy(*by, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        join_null_safe(counts, located, [*by, "_b"]).repartition(*by, "_b")  # at most one bucket per group and rank
        .withColumn("_hi", F.col("_before") + F.sum("_c").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_c")))
    at = lambda name: F.max(F.when(
        F.exists("_w", lambda s: (s["name"] == name) & (s["rank"] >= F.col("_lo")) & (s["rank"] < F.col("_hi"))),
        F.col("_x"))).alias(name)
    return picked.groupBy(*by).agg(F.first("n").alias("n"), *[at(name) for name in ranks])


def percentiles(df: DataFrame, value: str, by: list[str], qs: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation between ranks, per group, plus ``n``."""
    ranks = {}
    for name, q in qs.items():
        pos = (F.col("n") - 1) * F.lit(q)
        ranks[f"_{name}_lo"], ranks[f"_{name}_hi"] = F.floor(pos), F.ceil(pos)
    s = order_statistics(df, value, by, ranks)
    out = []
    for name, q in qs.items():
        pos = (F.col("n") - 1) * F.lit(q)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return s.select(*by, "n", *out)
