"""Joins, and components of links, that no hot key brings into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.session import cut

MOST_HOT = 1000


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``table``, which has one row per key and in ``n`` the key's number of rows.

    Keys with more than a thousandth of all rows, of which there can be no more than a thousand, are
    broadcast; the others meet by an ordinary join, where none fills a task. ``table`` should be
    stored: it is read several times. ``n`` is dropped. Null keys find no partner.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * MOST_HOT > F.lit(total)
    hot, rest = table.filter(is_hot).drop(n), table.filter(~is_hot).drop(n)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(cold.join(rest, keys))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Alternating large and small stars over stored rounds; a centre is found by an aggregate that is
    summed inside tasks first, and handed out by :func:`join_spread`.
    """
    now = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = cut(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        centre = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        large = join_spread(both.filter("v > u"), centre, ["u"])
        large = cut(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        centre = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_spread(large, centre, ["u"])
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.filter("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
