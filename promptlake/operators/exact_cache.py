"""The exact tier: lookups in a store, and attribution of repeats in a log under a TTL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from promptlake.operators.ordered import join_null_safe, latest_before
from promptlake.session import cut


def l1_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Requests with the answer stored under their key, if any."""
    return requests.join(store.select("cache_key", "content", "stored_at", "expires_at"),
                         "cache_key", "left")


def l1_lookup_asof(requests: DataFrame, store: DataFrame, bucket_s: int = 3600) -> DataFrame:
    """As :func:`l1_lookup`, but the store is a history of writes: the last write before the
    request counts, and only while it is alive."""
    found = latest_before(
        requests, store, ["cache_key"], "ts", "stored_at", "content",
        ["content", "stored_at", "expires_at"], bucket_s)
    alive = F.col("ts") < F.col("expires_at")
    for c in ("content", "stored_at", "expires_at"):
        found = found.withColumn(f"_{c}", F.when(alive, F.col(c)))
    names = [c for c in found.columns if not c.startswith("_") and c not in ("content", "stored_at", "expires_at")]
    return found.select(*names, *[F.col(f"_{c}").alias(c) for c in ("content", "stored_at", "expires_at")])


def hits(looked_up: DataFrame) -> DataFrame:
    return looked_up.filter(F.col("content").isNotNull())


def misses(requests: DataFrame, store: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests no entry exists for."""
    return requests.join(store, key, "left_anti")


def served(requests: DataFrame, store: DataFrame, key: str = "cache_key") -> DataFrame:
    """Requests an entry exists for."""
    return requests.join(store, key, "left_semi")


# --- repeats under a TTL ----------------------------------------------------------------

FINER = 5  # bits by which a part is cut when it is opened


def l1_attribute(requests: DataFrame, ttl_s: int = 86400, key: str = "cache_key", ts: str = "ts",
                 rid: str = "request_id", can_store: str | None = None, parts: int = 1440) -> DataFrame:
    """Adds ``l1_hit`` and ``anchor_ts``, the store time of the entry that serves the row.

    Per key in time order, a miss is stored and serves later rows until its TTL ends; a hit
    does not extend it. Rows whose ``can_store`` column is not true never store, nor do rows
    without a time, which miss. A null key is a key like any other.

    A key's time is cut into parts, at least ``parts`` a TTL, and every part is reduced to its
    first and last time before it is shuffled. The entries follow from this short list, unless
    one begins between a part's first and last time; only parts where one can are opened, into
    finer parts, and at most five such rounds end at single microseconds. Rows then meet the
    entries of their own part, so no task sees more of a key than one part's rows.

    The input is read several times, so it is stored first: pass narrow rows.
    """
    ttl_us = ttl_s * 1_000_000
    bits = max(0, (ttl_us // parts).bit_length() - 1)
    stores = F.coalesce(F.col(can_store), F.lit(False)) if can_store else F.lit(True)
    d = cut(requests).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns(
        {"_st": stores & F.col("_us").isNotNull(), "_b": F.shiftright("_us", bits)})
    entries = _entries(d, ttl_us, bits, key, rid)
    served = entries.select(key, "found", F.explode("buckets").alias("_b")).select(
        key, "_b",
        F.array_max(F.filter("found.t", lambda t: F.shiftright(t, bits) < F.col("_b"))).alias("_prev"),
        F.get(F.filter("found", lambda e: F.shiftright(e["t"], bits) == F.col("_b")), F.lit(0)).alias("_own"))
    own, own_id = F.col("_own.t"), F.col("_own.id")
    from_own = F.coalesce(F.col(rid) >= own_id, own_id.isNull())
    after_own = (F.col("_us") > own) | ((F.col("_us") == own) & from_own)
    own_row = F.coalesce((F.col("_us") == own) & F.col(rid).eqNullSafe(own_id), F.lit(False))
    return (
        join_null_safe(d, served, [key, "_b"])
        .withColumn("_anchor", F.when(after_own, own).when(F.col("_us") < F.col("_prev") + ttl_us, F.col("_prev")))
        .withColumn("l1_hit", F.col("_anchor").isNotNull() & ~own_row)
        .withColumn("anchor_ts", F.timestamp_micros("_anchor").cast(requests.schema[ts].dataType))
        .select(*requests.columns, "l1_hit", "anchor_ts"))


def _ends(points: DataFrame, by: list[str], rid: str) -> DataFrame:
    """First (time, id) and last time of the storing rows of each group."""
    return points.groupBy(*by).agg(
        F.min(F.when(F.col("_st"), F.struct(F.col("_us").alias("t"), F.col(rid).alias("id")))).alias("first"),
        F.max(F.when(F.col("_st"), F.col("_us"))).alias("last"))


def _chain(ttl_us: int, id_type: str, early: bool):
    """Entries along sorted parts. Inside a part that holds times on both sides of the moment the
    entry before ends, the next entry is taken as early, or as late, as it can be. Later entries
    begin no earlier for a later one before, so the two chains enclose the true one."""
    kind = f"array<struct<t:bigint,id:{id_type}>>"

    def step(state, part):
        due, first = state["due"], part["first"]
        sure = first["t"] >= due
        t = F.when(sure, first["t"]).otherwise(due if early else part["last"])
        entry = F.struct(t.alias("t"), F.when(sure, first["id"]).alias("id"))
        return F.when(part["last"] >= due, F.struct(
            (t + ttl_us).alias("due"), F.concat(state["found"], F.array(entry)).alias("found"))).otherwise(state)

    start = F.struct(F.lit(-2 ** 63).cast("bigint").alias("due"), F.array().cast(kind).alias("found"))
    return F.aggregate("pieces", start, step, lambda state: state["found"])


def _entries(d: DataFrame, ttl_us: int, bits: int, key: str, rid: str) -> DataFrame:
    """Per key, the numbers of its time parts (``buckets``) and its entries (``found``)."""
    id_type = d.schema[rid].dataType.simpleString()

    def chained(per_key):
        return cut(per_key.withColumns({
            "early": _chain(ttl_us, id_type, True), "found": _chain(ttl_us, id_type, False)}))

    piece = F.struct("first", "last", F.lit(bits).alias("bits"), F.col("_b").alias("part"))
    state = chained(_ends(d, [key, "_b"], rid).groupBy(key).agg(
        F.collect_list("_b").alias("buckets"),
        # rows without a time have no part, but are served like the rest: as misses
        F.max(F.col("_b").isNull()).alias("timeless"),
        F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), piece))).alias("pieces"))
        .withColumn("buckets", F.when(F.col("timeless"), F.concat("buckets", F.array(F.lit(None).cast("bigint"))))
                    .otherwise(F.col("buckets"))).drop("timeless"))
    sure = F.col("early.t") == F.col("found.t")
    unsure, points, refined = state.filter(~sure).drop("buckets"), None, []
    while not unsure.isEmpty():
        spans = F.filter(F.zip_with(F.col("early.t"), F.col("found.t"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                         lambda s: s["a"] < s["b"])
        within = lambda p: (p["first"]["t"] < p["last"]) & F.exists(
            "spans", lambda s: (s["a"] <= p["last"]) & (s["b"] >= p["first"]["t"]))
        u = unsure.withColumn("spans", spans)
        opened = cut(u.select(key, F.explode(F.filter("pieces", within)).alias("p")).select(key, "p.bits", "p.part"))
        if points is None:
            points = cut(join_null_safe(
                d.filter("_st").select(key, F.col(rid), "_us", "_st", F.col("_b").alias("part")),
                opened.select(key, "part"), [key, "part"]).drop("part"))
        finer = None
        for (level,) in opened.select("bits").distinct().collect():  # at most one for every FINER bits
            to = max(0, level - FINER)
            inside = join_null_safe(points.withColumn("part", F.shiftright("_us", level)),
                                    opened.filter(F.col("bits") == level).select(key, "part"), [key, "part"])
            cut_up = _ends(inside.withColumn("part", F.shiftright("_us", to)), [key, "part"], rid).select(
                key, F.struct("first", "last", F.lit(to).alias("bits"), "part").alias("p"))
            finer = cut_up if finer is None else finer.unionByName(cut_up)
        kept = u.select(key, F.explode(F.filter("pieces", lambda p: ~within(p))).alias("p"))
        again = chained(kept.unionByName(finer).groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("pieces")))
        refined.append(again.filter(sure).select(key, "found"))
        unsure = again.filter(~sure)
    out = state.filter(sure).select(key, "buckets", "found")
    for r in refined:
        out = out.unionByName(join_null_safe(state.filter(~sure).select(key, "buckets"), r, [key]))
    return out
