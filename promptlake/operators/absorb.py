"""Semantic absorption over a log: early prompts serve later ones that are close enough.

In time order a request either reuses one of its k nearest stored live entries or is stored
itself. Which entries exist depends on earlier decisions, so the log is settled in rounds. One
search lists for each request its nearest earlier requests that might be stored, more of them
than k; the rounds work on these links alone. A round settles at once every request whose outcome
no open candidate can change; the links to and from what it settled are marked or dropped before
the next. A request with a single open candidate left is stored or not as a function of that
candidate alone; chains of such requests are composed by pointer doubling, so that a chain of any
length is known in one round, after a number of joins that grows with its logarithm. Where too
many of a list turn out not to be stored, the request searches again among what is left. The
earliest open request can always be settled or search again, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.functions.text import extract_keywords, l2_eligible, numbers, tech_keywords
from promptlake.functions.validate import entry_numbers, entry_tech, validate_sets
from promptlake.operators.similarity import BLOCK_ROWS, knn
from promptlake.rules import Rules
from promptlake.session import cut, new_run_dir

_RULES = Rules()


def _features(requests: DataFrame, ttl_s: int, max_chars: int, rules: Rules, can_store: str | None) -> DataFrame:
    """What the rounds need to know of a request; texts stay behind."""
    keywords = extract_keywords("query_text", rules)
    ts = F.col("ts").cast("timestamp")
    d = requests.select(
        F.col("request_id").cast("string").alias("rid"), ts.alias("ts"),
        F.timestamp_micros(F.unix_micros(ts) + ttl_s * 1_000_000).alias("until"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.when(l2_eligible("query_text", max_chars), F.col("embedding")).alias("embedding"),
        (F.col(can_store) if can_store else F.lit(True)).alias("can_store"),
        numbers("query_text").alias("q_numbers"), tech_keywords("query_text", rules).alias("q_tech"),
        keywords.alias("_kw"))
    return d.withColumns({
        "e_numbers": entry_numbers("_kw"), "e_tech": entry_tech("_kw", rules)}).drop("_kw")


_FOUND = ("rid string, can_store boolean, was_full boolean, verdict string, sid string, similarity double, "
          "dep string, if_stored boolean, if_not boolean, round bigint")


def _outcomes(found: DataFrame) -> DataFrame:
    """(rid, l2_hit, entry_id, similarity, stored, round) of the requests that rounds settled."""
    hit = F.col("verdict") == "hit"
    return found.filter(F.col("verdict").isin("hit", "miss")).select(
        "rid", hit.alias("l2_hit"), F.when(hit, F.col("sid")).alias("entry_id"), F.when(hit, F.col("similarity")).alias("similarity"),
        (~hit & F.col("can_store")).alias("stored"), "round")


def _links(open_: DataFrame, pool: DataFrame, known: DataFrame, length: int, threshold: float, **layout) -> DataFrame:
    """(qid, rank, sid, similarity, ok, is_open, full): the ``length`` nearest of ``pool`` per
    request, whether they pass the checks, and whether the list could go on."""
    near = knn(open_, pool, length, threshold, qid="rid", sid="rid", q_at="ts", s_at="ts", s_until="until", **layout)
    q = known.select(F.col("rid").alias("qid"), F.col("lang").alias("q_lang"), "q_numbers", "q_tech")
    e = known.select(F.col("rid").alias("sid"), F.col("lang").alias("e_lang"), "e_numbers", "e_tech")
    ok = validate_sets("q_lang", "e_lang", "q_numbers", "e_numbers", "q_tech", "e_tech")["passed"]
    full = F.count(F.lit(1)).over(Window.partitionBy("qid")) == length
    return (
        near.join(pool.select(F.col("rid").alias("sid"), "is_open"), "sid").join(q, "qid").join(e, "sid")
        .select("qid", "rank", "sid", "similarity", ok.alias("ok"), "is_open", full.alias("full")))


def _decide(near: Column, full: Column, k: int) -> Column:
    """(verdict, sid, similarity) of a list of links: hit, miss, search (the list is used up) or wait.

    The first valid link that fewer than k stored entries precede decides, if it is stored and
    with all open ones before it still among the k. Without such a link the request is a miss,
    unless the list stopped short of k stored entries.
    """
    def step(state, link):
        n_stored, n_open = state["n_stored"], state["n_open"]
        decides = link["ok"] & (n_stored < k)
        found = F.struct(
            n_stored.alias("n_stored"), n_open.alias("n_open"), link["sid"].alias("sid"), link["similarity"].alias("similarity"),
            (~link["is_open"] & (n_stored + n_open < k)).alias("sure"))
        passed = F.struct(
            (n_stored + (~link["is_open"]).cast("int")).alias("n_stored"), (n_open + link["is_open"].cast("int")).alias("n_open"),
            state["sid"].alias("sid"), state["similarity"].alias("similarity"), state["sure"].alias("sure"))
        return F.when(state["sid"].isNotNull(), state).when(decides, found).otherwise(passed)

    def verdict(state):
        return F.struct(
            F.when(state["sid"].isNotNull(), F.when(state["sure"], "hit").otherwise("wait"))
            .when((state["n_stored"] >= k) | ~full, "miss").when(state["n_open"] > 0, "wait").otherwise("search").alias("verdict"),
            state["sid"].alias("sid"), state["similarity"].alias("similarity"))

    start = F.struct(F.lit(0).alias("n_stored"), F.lit(0).alias("n_open"), F.lit(None).cast("string").alias("sid"),
                     F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("sure"))
    return F.aggregate(near, start, step, verdict)


def _open_before_end(near: Column, k: int) -> Column:
    """Ids of the open links that can matter: those before a stored valid one and before k stored ones."""
    def step(state, link):
        seen = F.when(link["is_open"], F.concat(state["seen"], F.array(link["sid"]))).otherwise(state["seen"])
        n = state["n"] + (~link["is_open"]).cast("int")
        go_on = F.struct(seen.alias("seen"), n.alias("n"), ((~link["is_open"] & link["ok"]) | (n >= k)).alias("done"))
        return F.when(state["done"], state).otherwise(go_on)

    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    return F.aggregate(near, start, step, lambda state: state["seen"])


_LINK = "array<struct<rank:int,sid:string,similarity:double,ok:boolean,is_open:boolean>>"


class _Round:
    """The columns that settle a round; built once, as every round uses the same."""

    def __init__(self, k: int):
        near, full = F.col("near"), F.col("full")
        before = _open_before_end(near, k)
        self.now = _decide(near, full, k)
        self.dep = F.when(F.size(before) == 1, F.get(before, F.lit(0)))
        self.yes = _decide(F.transform(near, lambda x: x.withField("is_open", F.lit(False))), full, k)["verdict"]
        self.no = _decide(F.filter(near, lambda x: x["sid"] != F.col("dep")), full, k)["verdict"]

    def verdicts(self, links: DataFrame, open_: DataFrame) -> DataFrame:
        """``open_`` with a verdict. A waiting request that hangs on one open candidate alone names it in
        ``dep``, with whether it will be stored if that one is (``if_stored``) or is not (``if_not``)."""
        near = F.array_sort(F.collect_list(F.struct("rank", "sid", "similarity", "ok", "is_open")))
        lists = links.groupBy(F.col("qid").alias("rid")).agg(near.cast(_LINK).alias("near"), F.max("full").alias("full"))
        # a full list loses all its links if none was stored: ``was_full`` is kept with the request
        d = open_.join(lists, "rid", "left").withColumns(
            {"full": F.coalesce("full", "was_full"), "near": F.coalesce("near", F.array().cast(_LINK))})
        d = d.withColumns({"now": self.now, "dep": self.dep})
        single = (F.col("now.verdict") == "wait") & F.col("dep").isNotNull()
        d = d.withColumns({"yes": F.when(single, self.yes), "no": F.when(single, self.no)})
        sure = single & F.col("yes").isin("hit", "miss") & F.col("no").isin("hit", "miss")
        will = lambda c: F.when(sure, (F.col(c) == "miss") & F.col("can_store"))
        return d.select("rid", "can_store", F.col("full").alias("was_full"), "now.*", F.when(sure, F.col("dep")).alias("dep"),
                        will("yes").alias("if_stored"), will("no").alias("if_not"))


def _double(chain: DataFrame) -> DataFrame:
    """Every row of (rid, dep, if_stored, if_not) as a function of its candidate's candidate."""
    ahead = chain.select(F.col("rid").alias("dep"), F.col("dep").alias("far"), F.col("if_stored").alias("far_stored"), F.col("if_not").alias("far_not"))
    through = lambda c, old: F.when(F.col("far").isNull(), F.col(old)).otherwise(F.when(F.col(c), F.col("if_stored")).otherwise(F.col("if_not")))
    return chain.join(ahead, "dep", "left").select(
        "rid", F.coalesce("far", "dep").alias("dep"), through("far_stored", "if_stored").alias("if_stored"),
        through("far_not", "if_not").alias("if_not"), F.col("far").isNotNull().alias("moved"))


def _known(found: DataFrame, chained: bool) -> DataFrame:
    """(sid, now_stored): what a round tells of its requests, settled or at the end of a chain."""
    settled = found.filter(F.col("verdict").isin("hit", "miss")).select("rid", ((F.col("verdict") == "miss") & F.col("can_store")).alias("stored"))
    sure = settled.unionByName(found.filter("if_stored = if_not").select("rid", F.col("if_stored").alias("stored")))
    if chained:
        chain = found.filter("if_stored <> if_not").select("rid", "dep", "if_stored", "if_not")
        while True:
            doubled = cut(_double(_double(chain).drop("moved")))
            chain = doubled.drop("moved")
            if doubled.filter("moved").isEmpty():
                break
        ends = chain.join(sure.select(F.col("rid").alias("dep"), "stored"), "dep")
        sure = sure.unionByName(ends.select("rid", F.when(F.col("stored"), F.col("if_stored")).otherwise(F.col("if_not")).alias("stored")))
    return sure.select(F.col("rid").alias("sid"), F.col("stored").alias("now_stored"))


def semantic_absorb(requests: DataFrame, threshold: float = 0.75, k: int = 3, ttl_s: int = 86400,
                    max_chars: int = 300, rules: Rules = _RULES, can_store: str | None = None,
                    max_rounds: int | None = None, initial: DataFrame | None = None,
                    length: int = 16, slice_rows: int | None = None, **layout) -> DataFrame:
    """(request_id, l2_hit, entry_id, similarity, stored, round) for every request.

    Columns needed: request_id, ts, query_text, lang, embedding. Requests without an
    embedding or with a long text take no part (round 0). ``can_store`` names a flag for
    requests that may reuse entries but never become one. ``max_rounds`` raises when exceeded;
    it never ends the work early. ``initial`` holds entries stored before the log begins
    (entry_id, embedding, lang, keywords, stored_at, expires_at). ``length`` is how many
    candidates a search lists; the outcome is the same for any length of at least k. ``slice_rows``
    is still taken and has no effect: rounds go over the whole log.
    """
    length = max(length, k)
    feats = cut(_features(requests, ttl_s, max_chars, rules, can_store))
    spark = feats.sparkSession
    takes_part = F.col("embedding").isNotNull()
    n_active = feats.filter(takes_part).count()
    open_ = feats.filter(takes_part).select("rid", "can_store", F.lit(False).alias("was_full"))
    known = feats.select("rid", "lang", "q_numbers", "q_tech", "e_numbers", "e_tech")
    columns = ["rid", "ts", "until", "embedding"]
    active = feats.filter(takes_part).select(*columns, "can_store")
    pool = active.filter("can_store").select(*columns, F.lit(True).alias("is_open"))
    if initial is not None:
        old = cut(initial.select(
            F.col("entry_id").cast("string").alias("rid"), F.col("stored_at").cast("timestamp").alias("ts"),
            F.col("expires_at").cast("timestamp").alias("until"), "embedding",
            F.coalesce("lang", F.lit("")).alias("lang"), numbers(F.lit("")).alias("q_numbers"),
            numbers(F.lit("")).alias("q_tech"), entry_numbers("keywords").alias("e_numbers"),
            entry_tech("keywords", rules).alias("e_tech")))
        known = known.unionByName(old.select(*known.columns))
        pool = pool.unionByName(old.select(*columns, F.lit(False).alias("is_open")))
    if "pivots" not in layout:
        layout = {**layout, "pivots": min(256, n_active // (4 * BLOCK_ROWS))}
    settled = new_run_dir(spark, "absorbed")
    read = lambda path: spark.read.schema(_FOUND).parquet(path)
    links = cut(_links(active, pool, known, length, threshold, **layout))
    rule, n_round = _Round(k), 0
    while True:
        n_round += 1
        if max_rounds is not None and n_round > max_rounds:
            raise RuntimeError(f"not settled after {max_rounds} rounds")
        rule.verdicts(links, open_).withColumn("round", F.lit(n_round).cast("bigint")).write.parquet(f"{settled}/part={n_round}")
        found = read(f"{settled}/part={n_round}")
        left = found.groupBy().agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("wait", "search")],
                                   F.count_if(F.col("if_stored") != F.col("if_not")).alias("chained")).first()
        if not left["wait"] + left["search"]:
            break
        # who searches again starts with a new list
        open_ = found.filter(F.col("verdict").isin("wait", "search")).select(
            "rid", "can_store", (F.col("was_full") & (F.col("verdict") == "wait")).alias("was_full"))
        now = _known(found, left["chained"] > 0)
        waiting = found.filter(F.col("verdict") == "wait").select(F.col("rid").alias("qid"))
        kept = (
            links.join(waiting, "qid", "left_semi").join(now, "sid", "left")
            .filter(F.coalesce("now_stored", F.lit(True)))
            .select("qid", "rank", "sid", "similarity", "ok",
                    (F.col("is_open") & F.col("now_stored").isNull()).alias("is_open"), "full"))
        if left["search"]:
            done = _outcomes(read(settled)).select("rid", "stored")
            again = active.join(found.filter(F.col("verdict") == "search").select("rid"), "rid", "left_semi")
            rest = pool.join(done, "rid", "left").filter(F.coalesce("stored", F.lit(True))).select(
                *columns, (F.col("is_open") & F.col("stored").isNull()).alias("is_open"))
            kept = kept.unionByName(_links(again, rest, known, length, threshold, **layout))
        links = cut(kept)
    idle = feats.filter(~takes_part).select("rid", *[F.lit(v).cast(t).alias(c) for c, t, v in (
        ("l2_hit", "boolean", False), ("entry_id", "string", None), ("similarity", "double", None), ("stored", "boolean", False), ("round", "bigint", 0))])
    return _outcomes(read(settled)).unionByName(idle).withColumnRenamed("rid", "request_id")
