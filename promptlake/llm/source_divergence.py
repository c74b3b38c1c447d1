"""Source divergence audit with late strings.

Each task counts the terms of its texts by (language, source, term) and writes the counts with the
terms to the shared folder. From there only fixed-width digests are shuffled: first to find the
digests in enough documents of a language, then to count those by source. The smallest and largest
string of a kept digest show whether it stands for more than one term; such digests are split by
their strings. Strings are joined back for the terms that are returned.

Shares are whole numbers: a kept term with ``n`` occurrences in a group of ``N`` kept ones, ``V``
kept terms in the language, has p = 1 + floor(UNIT * (n + 2) / (N + 2 V)). A term's divergence
between p and q is floor((p - q)^2 / (p + q)). The sources of a language are compared in blocks of
terms and sources: only terms that a pair has are looked at, the rest of the vocabulary is alike.

Null text, language and source count as ''. A text without terms counts as an occurring group.
Repeated rows count each. Equal values are ranked by the item's UTF-8 bytes. A language without kept
terms has pairs of value 0 and no terms; one with a single source has no pairs. An empty table gives
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from promptlake.llm.batches import broadcast_if_small, chunks, text_bytes, word_spans
from promptlake.llm.filter_audit import as_strings, encode_words
from promptlake.session import cut

UNIT = 1_000_000_000  # fixed value
CHUNK = 1 << 23
HELD = 1 << 20
TERMS, SOURCES = 2048, 128  # of a block
_KEY = ["lang", "digest", "sub"]


def _count(langs: pa.Array, sources: pa.Array, texts: pa.Array) -> pa.Table:
    """(lang, source, term, n, docs) of some texts."""
    buf, offsets = text_bytes(texts)
    upper = (buf >= 65) & (buf <= 90)
    gap = ~(upper | ((buf >= 97) & (buf <= 122)) | (buf >= 128))
    starts, ends, text_of = word_spans(gap, offsets)
    coded = encode_words(buf + np.uint8(32) * upper, gap, starts, ends)
    size = max(1, len(coded.dictionary))
    cells, n = np.unique(text_of * size + np.asarray(coded.indices, np.int64), return_counts=True)
    l, s = langs.dictionary_encode(), sources.dictionary_encode()
    group = np.asarray(l.indices, np.int64) * len(s.dictionary) + np.asarray(s.indices, np.int64)
    found, at = np.unique(group[cells // size] * size + cells % size, return_inverse=True)
    g, term = found // size, found % size
    return pa.table({
        "lang": l.dictionary.take(pa.array(g // max(1, len(s.dictionary)))), "source": s.dictionary.take(pa.array(g % max(1, len(s.dictionary)))),
        "term": as_strings(coded.dictionary.take(pa.array(term))),
        "n": np.bincount(at, n, len(found)).astype(np.int64), "docs": np.bincount(at, minlength=len(found)).astype(np.int64)})


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", bits: int = 64) -> DataFrame:
    """(lang, source, term, n, docs, digest), summed inside tasks only; stored. ``bits``: of a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
            return t.rename_columns(["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for lo, hi in chunks(batch["t"], CHUNK):
                own = batch.slice(lo, hi - lo)
                held.append(_count(own["lang"], own["source"], own["t"]))
                if sum(map(len, held)) > HELD:
                    held[:] = [merged()]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "t"))])
    counted = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return cut(counted.withColumn("digest", F.shiftrightunsigned(F.xxhash64("term"), 64 - bits) if bits < 64 else F.xxhash64("term")))


def kept_terms(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The counts (lang, digest, sub, source, n) of terms in at least ``least`` documents of their
    language, and their names (lang, digest, sub, term). ``sub`` is '' for a digest of one term only;
    the terms of a split digest have their own string there."""
    many = counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    many = broadcast_if_small(cut(many.select("lang", "digest")))
    # the strings of those digests, once each
    said = cut(counts.join(many, ["lang", "digest"]).select("lang", "digest", "term").distinct())
    spans = cut(said.groupBy("lang", "digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi")))
    one, several = spans.filter("lo = hi"), broadcast_if_small(spans.filter("lo <> hi").select("lang", "digest"))
    names = one.select("lang", "digest", F.lit("").alias("sub"), F.col("lo").alias("term"))
    plain = counts.join(broadcast_if_small(one.select("lang", "digest")), ["lang", "digest"]).groupBy("lang", "digest", "source").agg(F.sum("n").alias("n"))
    split = counts.join(several, ["lang", "digest"]).groupBy("lang", "digest", "source", F.col("term").alias("sub")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    split = cut(split)
    named = split.groupBy("lang", "digest", "sub").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    found = plain.select(*_KEY[:2], F.lit("").alias("sub"), "source", "n").unionByName(split.drop("docs").join(named, _KEY, "left_semi"))
    return cut(found), cut(names.unionByName(named.withColumn("term", F.col("sub"))))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term, exactly."""
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    return F.lit(1).cast("long") + F.call_function("div", big(F.lit(UNIT), 10) * big(n + 2, 20), big(total + 2 * terms, 20))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(key: tuple, part: pa.Table, size: int) -> pa.Table:
    """Sums over a block's terms, per pair of its sources, of the divergence less that of absent terms."""
    _, _, a, b = (k.as_py() for k in key)
    no, p = np.asarray(part["no"], np.int64), np.asarray(part["p"], np.int64)
    at = np.asarray(part["term"], np.int64)
    names, row = np.unique(no, return_inverse=True)
    absent = np.zeros(len(names), np.int64)
    absent[row[at < 0]] = p[at < 0]
    terms, column = np.unique(at[at >= 0], return_inverse=True)
    table = np.repeat(absent[:, None], len(terms), axis=1)
    table[row[at >= 0], column] = p[at >= 0]
    left = np.flatnonzero(names // size == a)
    right = np.flatnonzero(names // size == b)
    out: tuple[list, list, list] = ([], [], [])

    def apart(x, y):
        return (x - y) * (x - y) // np.maximum(x + y, 1)

    for i in left:
        others = right[names[right] > names[i]]
        if len(others):
            sums = apart(table[i], table[others]).sum(axis=1) - len(terms) * apart(absent[i], absent[others])
            for o, x in zip(out, (np.full(len(others), names[i]), names[others], sums)):
                o.append(x)
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({"lang": pa.array([key[0].as_py()] * len(flat[0]), pa.string()), "i": flat[0], "j": flat[1], "more": flat[2]})


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language. ``groups``: (lang, source, no,
    terms, p0), numbered from 0 in each language; ``shares``: (lang, digest, sub, no, terms, p)."""
    size = SOURCES
    buckets = F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("int")
    mine = shares.select("lang", "no", "p", F.pmod(F.xxhash64("digest", "sub"), buckets).cast("int").alias("bucket"), F.xxhash64("sub", "digest").alias("term"), "terms")
    term = F.col("term").bitwiseAND(F.lit((1 << 63) - 1))  # a block holds some thousand terms
    base = groups.select("lang", "no", F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0), buckets - 1)).alias("bucket"), F.lit(-1).cast("long").alias("term"), "terms")
    most = groups.groupBy("lang").agg(F.max("no").alias("last"))
    rows = mine.withColumn("term", term).unionByName(base).join(broadcast_if_small(most), "lang").withColumn("own", F.floor(F.col("no") / size).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / size).cast("int")))).select(
        "lang", "bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "no", "term", "p")

    def blocks(key: tuple, part: pa.Table) -> pa.Table:
        return _block_sums(key, part, size)

    sums = dealt.groupBy("lang", "bucket", "a", "b").applyInArrow(blocks, "lang string, i long, j long, more long").groupBy("lang", "i", "j").agg(F.sum("more").alias("more"))
    small = broadcast_if_small(groups.select("lang", "source", "no", "terms", "p0"))
    x = small.select("lang", F.col("no").alias("i"), F.col("source").alias("one"), F.col("p0").alias("p"))
    y = small.select("lang", F.col("no").alias("j"), F.col("source").alias("two"), F.col("p0").alias("q"), "terms")
    found = sums.join(broadcast_if_small(x), ["lang", "i"]).join(broadcast_if_small(y), ["lang", "j"])
    found = found.withColumn("value", F.when(F.col("terms") > 0, F.col("more") + F.col("terms") * divergence(F.col("p"), F.col("q"))).otherwise(F.lit(0)).cast("long"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return found.select("lang", "value", both.alias("x")).select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = 10, top: int = 10, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): every two sources of a language compared over all kept
    terms (``pair``), and the ``top`` terms that a group has more of than its language (``term``)."""
    counts, names = kept_terms(term_counts(docs, lang, source, text, bits), least)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    here = docs.groupBy(plain(lang).alias("lang"), plain(source).alias("source")).agg(F.count("*").alias("rows")).drop("rows")
    terms = names.groupBy("lang").agg(F.count("*").alias("terms"))
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = here.join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms")])
    no = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(F.lit(0)).cast("long")
    groups = cut(groups.withColumn("no", no).withColumn("p0", p0))
    shares = cut(counts.join(broadcast_if_small(groups.drop("p0")), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"))))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    overall = counts.groupBy(*_KEY).agg(F.sum("n").alias("n")).join(broadcast_if_small(whole), "lang").join(terms, "lang")
    overall = overall.select(*_KEY, share(F.col("n"), F.col("all"), F.col("terms")).alias("q"))
    above = shares.join(overall, _KEY).filter("p > q").select(*_KEY, "source", divergence(F.col("p"), F.col("q")).alias("value"))
    # equal values at the border stay until their strings can tell
    rank = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    best = above.withColumn("rank", rank).filter(F.col("rank") <= top).drop("rank").join(names, _KEY)
    ordered = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    best = best.withColumn("item", F.col("term")).withColumn("rank", ordered).filter(F.col("rank") <= top)
    pairs = _pairs(shares, groups).withColumn("rank", ordered)
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(best, "term"))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  k AS (SELECT lang, term FROM d GROUP BY ALL HAVING count(DISTINCT id) >= 10),
  g AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  c AS (SELECT lang, source, term, count(*) AS n FROM d SEMI JOIN k USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
  f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v.v FROM g JOIN k USING (lang) JOIN v USING (lang)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM f),
  w AS (SELECT lang, term, sum(n) AS n, any_value(v) AS v FROM f GROUP BY ALL),
  q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS BIGINT) AS q FROM w),
  pairs AS (SELECT a.lang, a.source, b.source AS item,
      (SELECT 0) + coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term
        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
  terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
  r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
