"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. Character Markov models add to them: one model of
transitions is counted over the values the patterns find (random strings), one over all other
long tokens of the corpus (ordinary identifiers), and a long token outside the base spans is a
secret if its mean log-likelihood ratio per transition exceeds a threshold. Both counts are taken
over all texts and combined before the shuffle; what reaches the driver is the table of
transitions, at most 65 x 65 numbers, which is then a constant of the scan.

Positions come from the lengths of the matches and of the gaps between them, summed in blocks.
Null text counts as empty; it has no spans. Rows are independent, so repeats do no harm. With no
random or no ordinary tokens to learn from nothing is added to the base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# fixed patterns of the base scan
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["passw", "secret", "token", "apikey", "api_key"]
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
SPANS = "array<struct<start:int,kind:int,stop:int>>"
BLOCK = 256
BACK_OFF = 10.0


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, also inside the lambdas of ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _none() -> Column:
    return F.array().cast(SPANS)


def _spans(text: Column, pattern: str, kind: int, hits: Column, good) -> Column:
    """Spans of the matches ``hits`` of ``pattern`` that are ``good``."""

    def walk(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), _none().alias("out"))

        def step(acc, p):
            begin = acc["at"] + p["gap"]
            end = begin + p["len"]
            span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")))
            return F.struct(end.alias("at"), F.when(p["ok"], F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def in_blocks(pieces: Column) -> Column:
        many = F.ceil(F.size(pieces) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), many - 1), lambda b: F.slice(pieces, b * BLOCK + 1, BLOCK))

    def offsets(blocks: Column) -> Column:
        total = lambda x: F.aggregate(x, F.lit(0), lambda a, p: a + p["gap"] + p["len"])
        return F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + total(x))))

    spans = _let(F.split(text, pattern, -1), lambda gaps: _let(
        F.transform(hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(h).alias("len"), good(h).alias("ok"))),
        lambda pieces: _let(in_blocks(pieces), lambda blocks: _let(
            offsets(blocks), lambda at: F.flatten(F.transform(blocks, lambda x, b: walk(x, F.get(at, b))))))))
    return F.when(F.size(hits) > 0, spans).otherwise(_none())


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 1)


def _base_hits(text: Column) -> dict[str, Column]:
    """Matches of each pattern; a cheap look for what any match contains goes first."""
    low = F.lower(text)
    may = low.contains(ASSIGN_WORDS[0])
    for w in ASSIGN_WORDS[1:]:
        may = may | low.contains(w)
    none = F.array().cast("array<string>")
    return {
        "h_assign": F.when(may, _hits(text, ASSIGN)).otherwise(none),
        "h_access": F.when(text.contains("AKIA"), _hits(text, ACCESS)).otherwise(none),
        "h_hex": _hits(text, HEX),
    }


def _ordinary(token: Column) -> Column:
    return ~token.rlike(f"{ACCESS}|{HEX}")


def transitions(docs: DataFrame, text: str = "text", least: int = 20) -> dict[tuple[str, str], float]:
    """log P_random(b | a) - log P_ordinary(b | a) for all transitions of the alphabet.

    Distinct tokens count once, so copies weigh nothing. Both models back off to their single
    characters; ordinary transitions are discounted by one, for any token's own count would
    otherwise speak against its being random.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    found = docs.select(t.alias("t")).select("t", *[c.alias(n) for n, c in _base_hits(F.col("t")).items()])
    values = F.filter(F.transform("h_assign", _value), lambda v: F.length(v) >= LEAST_VALUE)
    found = found.withColumn("assign", _spans(F.col("t"), ASSIGN, 0, F.col("h_assign"), lambda h: F.length(_value(h)) >= LEAST_VALUE))
    rest = F.when(F.size("assign") > 0, _blank(F.col("t"), F.col("assign"))).otherwise(F.col("t"))
    random = F.concat(values, "h_access", "h_hex")
    plain = F.filter(_hits(rest, f"{TOKEN}{{{least},}}"), _ordinary)
    tokens = found.select(F.explode(F.concat(
        F.transform(random, lambda v: F.struct(v.alias("token"), F.lit(True).alias("random"))),
        F.transform(plain, lambda v: F.struct(v.alias("token"), F.lit(False).alias("random"))))).alias("x")).select("x.*").distinct()
    pairs = tokens.filter(F.length("token") > 1).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))).alias("pair"))
    counts = pairs.filter(F.col("pair").rlike(f"^{TOKEN}{{2}}$")).groupBy("pair").agg(
        F.sum(F.col("random").cast("long")).alias("r"), F.sum((~F.col("random")).cast("long")).alias("o"))
    table = {row["pair"]: (row["r"], row["o"]) for row in counts.toLocalIterator()}
    size = [sum(x[k] for x in table.values()) for k in (0, 1)]
    if not all(size):
        return {}
    single = [{b: (sum(table.get(a + b, (0, 0))[k] for a in ALPHABET) + 0.5) / (size[k] + 0.5 * len(ALPHABET)) for b in ALPHABET} for k in (0, 1)]

    def chance(a: str, b: str, k: int, off: int) -> float:
        row = [table.get(a + c, (0, 0))[k] for c in ALPHABET]
        moved = BACK_OFF + off * sum(n > 0 for n in row)
        return (max(table.get(a + b, (0, 0))[k] - off, 0) + moved * single[k][b]) / (sum(row) + BACK_OFF)

    return {(a, b): math.log(chance(a, b, 0, 0)) - math.log(chance(a, b, 1, 1)) for a in ALPHABET for b in ALPHABET}


def _ratio(token: Column, weights: dict[tuple[str, str], float]) -> Column:
    """Mean log-likelihood ratio of a token's transitions."""
    table = F.from_json(F.lit(str([round(weights[a, b], 4) for a in ALPHABET for b in ALPHABET])), "array<double>")
    at = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    n = F.length(token) - 1
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + F.get(table, (at(i) - 1) * len(ALPHABET) + at(i + 1) - 1))
    return total / n


def scan(docs: DataFrame, text: str = "text", weights: dict[tuple[str, str], float] | None = None,
         least: int = 20, threshold: float = 0.25) -> DataFrame:
    """``docs`` with ``secret_spans``: all spans (start, kind, stop) in code points, by start and
    kind, kinds numbered as in KINDS. A column of that name is replaced."""
    weights = transitions(docs, text, least) if weights is None else weights
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    # columns of docs stay in one struct, so that none can clash with ours
    rest = [c for c in docs.columns if c.lower() != "secret_spans"]
    held = docs.select(t.alias("t"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("r"))
    found = held.select("r", "t", *[c.alias(n) for n, c in _base_hits(F.col("t")).items()])
    any_ = lambda h: F.lit(True)
    spans = found.select(
        "r", "t", _spans(F.col("t"), ASSIGN, 0, F.col("h_assign"), lambda h: F.length(_value(h)) >= LEAST_VALUE).alias("assign"),
        F.concat(_spans(F.col("t"), ACCESS, 1, F.col("h_access"), any_), _spans(F.col("t"), HEX, 2, F.col("h_hex"), any_)).alias("runs"))
    if weights:
        # assigned values are blanked; runs of the other kinds are told by the token itself
        blanked = F.when(F.size("assign") > 0, _blank(F.col("t"), F.col("assign"))).otherwise(F.col("t"))
        pattern = f"{TOKEN}{{{least},}}"
        bad = lambda h: _ordinary(h) & (_ratio(h, weights) > threshold)
        spans = (
            spans.select("r", "t", "assign", "runs", blanked.alias("b"))
            .select("r", "assign", "runs", "b", _hits(F.col("b"), pattern).alias("tokens"))
            .select("r", "assign", "runs", "b", "tokens", F.exists("tokens", bad).alias("some"))
            .select("r", "assign", "runs", F.when(F.col("some"), _spans(F.col("b"), pattern, 3, F.col("tokens"), bad)).otherwise(_none()).alias("more")))
    else:
        spans = spans.select("r", "assign", "runs", _none().alias("more"))
    joined = F.array_sort(F.concat("assign", "runs", "more"))
    return spans.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(rest)], joined.alias("secret_spans"))


def _pieces(text: Column, spans: Column, fill) -> Column:
    """``text`` with ``fill(span)`` in place of each of the ordered, disjoint ``spans``."""
    last = F.when(F.size(spans) > 0, F.element_at(spans, -1)["stop"]).otherwise(F.lit(0))
    begin = lambda i: F.when(i > 0, F.get(spans, i - 1)["stop"]).otherwise(F.lit(0))
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, begin(i) + 1, s["start"] - begin(i)), fill(s)))
    return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))


def _blank(text: Column, spans: Column) -> Column:
    return _let(spans, lambda s: _pieces(text, s, lambda x: F.repeat(F.lit(" "), x["stop"] - x["start"])))


def _disjoint(spans: Column) -> Column:
    """Ordered spans with those that overlap merged into one."""

    def step(acc, s):
        apart = (F.size(acc) == 0) | (F.element_at(acc, -1)["stop"] <= s["start"])
        top = F.element_at(acc, -1)
        wider = F.struct(top["start"].alias("start"), top["kind"].alias("kind"), F.greatest(top["stop"], s["stop"]).alias("stop"))
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider)))

    return F.aggregate(spans, _none(), step)


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span that ``scan`` finds replaced by ``mark``; null texts stay null."""
    found = scan(docs, text, **options)
    clean = _let(_disjoint(F.col("secret_spans")), lambda s: _pieces(F.col(f"`{text}`").cast("string"), s, lambda x: F.lit(mark)))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(f"`{text}`"))).drop("secret_spans")


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
