"""LM scoring by cross-entropy difference.

Two word bigram models, one of a target sample and one of the whole corpus as background, share
one vocabulary, the corpus's own words, and one smoothing. Each text's score is the mean over its
words of log p_background - log p_target, the target cross entropy less the background one: the
lower, the more like the target. Words and pairs are known by 62-bit hashes; their counts cover
every text and grow with the corpus.

Counts are summed inside each task before any shuffle. Common words and pairs, at most
``most_words`` and ``most_pairs`` of them, are broadcast with their exact counts over all texts;
which pairs are common is told from a random sample of about ``SAMPLE`` words. Every other
occurrence becomes a row (key, text hash), one for each text: the key is the word or, if the word
is a common one, the pair. Rows of a key meet in one shuffle and are counted there by windows, and
their losses are summed per text; so rows grow in step with the corpus, and no process holds a
group. A key that is left out of the broadcast has a small share of the rows. Limits and sample
route work and change no result.

The target is a set of ids: all rows labelled 1, joined by broadcast only if measured small.
Null or wordless text: no words, score 0. Repeated rows count as often as they occur. With no
target rows both models are compared with a uniform target. A very long text is cut nowhere. An
empty table gives an empty result. Columns of the input named as those of SCHEMA are replaced, all
others are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from promptlake.llm.batches import broadcast_if_small, chunks, is_space, lower, mix, span_hashes, text_bytes, word_spans
from promptlake.llm.spread import join_spread
from promptlake.session import cut

SCHEMA = "n_words long, target_entropy double, background_entropy double, score double"
BITS = 62
HELD = 1 << 20
SAMPLE = 20_000_000
UNIT = float(1 << 28)  # losses are summed as whole numbers, so that no order of adding shows
_R = np.uint64(0x9E3779B97F4A7C15)
_START = np.uint64(1 << BITS)


def _words(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its id, that of the word before it (``2**bits`` at a text's start) and its text."""
    buf, offsets = text_bytes(texts)
    starts, ends, text_of = word_spans(is_space(buf), offsets)
    h = span_hashes(lower(buf), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    word = h >> np.uint64(64 - bits)
    before = np.full(len(h), 1 << bits, np.uint64)
    if len(h):
        before[1:] = np.where(text_of[1:] == text_of[:-1], word[:-1], before[1:])
    return word, before, text_of


def _pair(before: np.ndarray, word: np.ndarray, bits: int = BITS) -> np.ndarray:
    return mix(mix(before + np.uint64(1)) + word * _R) >> np.uint64(64 - bits)


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each ``x`` in the sorted ``table``, -1 if it is not there."""
    if not len(table):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _mark(docs: DataFrame, text: str, target: DataFrame, key: str) -> DataFrame:
    """(t, in_target) of every row."""
    ids = broadcast_if_small(target.select(F.col(key).alias("k")).distinct().withColumn("in_target", F.lit(True)))
    return docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).join(ids, "k", "left").select("t", "in_target")


def _count(marked: DataFrame, slots) -> DataFrame:
    """(slot, n, n_target) of what ``slots`` gives for each chunk: slots and the texts they are of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            slot, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return slot, *(np.bincount(at, np.concatenate([x[i] for x in held]), len(slot)).astype(np.int64) for i in (1, 2))

        def record(x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].astype(np.int64)), pa.array(x[1]), pa.array(x[2])], ["slot", "n", "n_target"])

        for batch in batches:
            for lo, hi in chunks(batch["t"]):
                part = batch.slice(lo, hi - lo)
                slot, text_of = slots(part["t"])
                mine = part["in_target"].is_valid().to_numpy(zero_copy_only=False)[text_of]
                held.append((slot, np.ones(len(slot), np.int64), mine.astype(np.int64)))
                if sum(len(x[0]) for x in held) > HELD:
                    held[:] = [merged()]
                    if len(held[0][0]) > HELD // 2:
                        yield record(held.pop())
        if held:
            yield record(merged())

    return marked.mapInArrow(run, "slot long, n long, n_target long").groupBy("slot").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def count(docs: DataFrame, text: str, target: DataFrame, key: str, word_bits: int = BITS, pair_bits: int = BITS) -> DataFrame:
    """(slot, n, n_target): how often each slot occurs in all texts and in the target's. Pairs have
    slots from 0, words from ``2**pair_bits``."""

    def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, before, text_of = _words(texts, word_bits)
        return np.concatenate([_pair(before, word, pair_bits), word + np.uint64(1 << pair_bits)]), np.concatenate([text_of, text_of])

    return _count(_mark(docs, text, target, key), slots)


def _common(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots that occur at least a power of two times, the least that leaves no more than
    ``most`` of them, in order, with their counts."""
    sizes = sorted(((r["p"], r["rows"]) for r in table.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    left, least = most, None
    for p, rows in sizes:
        if rows > left:
            break
        left, least = left - rows, p
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    rows = table.filter(F.floor(F.log2("n")) >= least).toArrow()  # at most ``most``
    slot = np.asarray(rows["slot"], np.int64).astype(np.uint64)
    order = np.argsort(slot)
    return slot[order], np.asarray(rows["n"], np.float64)[order], np.asarray(rows["n_target"], np.float64)[order]


def _whole(loss: np.ndarray) -> np.ndarray:
    return np.rint(loss * UNIT).astype(np.int64)


def _exact(marked: DataFrame, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs ``known``, in order, with their counts over all texts: sums of a task are as many
    as there are known pairs, however long its input."""
    pairs = marked.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n_target = np.zeros((2, len(pairs.value)), np.int64)
        for batch in batches:
            for lo, hi in chunks(batch["t"]):
                part = batch.slice(lo, hi - lo)
                word, before, text_of = _words(part["t"])
                at = _find(pairs.value, _pair(before, word))
                at[before == _START] = -1
                mine = part["in_target"].is_valid().to_numpy(zero_copy_only=False)[text_of]
                n += np.bincount(at[at >= 0], minlength=len(n))
                n_target += np.bincount(at[(at >= 0) & mine], minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, n[some], n_target[some])], ["at", "n", "n_target"])

    if not len(known):
        return known, np.zeros(0), np.zeros(0)
    found = marked.mapInArrow(run, "at long, n long, n_target long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
    counts = np.zeros((2, len(known)))  # the sample drew each pair from the texts, so each has a row
    counts[:, np.asarray(found["at"], np.int64)] = np.asarray(found["n"], np.float64), np.asarray(found["n_target"], np.float64)
    return known, *counts


def _total(c: str):
    """Sum of whole numbers, in two halves that do not overflow for any number of copies."""
    low = F.col(c).bitwiseAND(F.lit((1 << 24) - 1))
    return F.sum(F.shiftright(c, 24)).cast("double") * float(1 << 24) + F.sum(low).cast("double")


def difference(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", strength: float = 8.0,
               most_words: int = 1 << 16, most_pairs: int = 1 << 19) -> DataFrame:
    """``docs`` with the columns of SCHEMA; ``target``: the ids of the target sample."""
    spark = docs.sparkSession
    marked = _mark(docs, text, target, key)

    def only_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, _, text_of = _words(texts)
        return word, text_of

    table = cut(_count(marked, only_words))
    total = table.agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).first()
    size, ours = float(total["n"] or 0), float(total["n_target"] or 0)
    scale = ours / size if ours else 1.0  # matched: the background's counts are brought to the target's size
    mass = (ours + total["words"], size * scale + total["words"])
    words = spark.sparkContext.broadcast(_common(table, most_words))

    def common_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, before, text_of = _words(texts)
        both = (_find(words.value[0], word) >= 0) & (_find(words.value[0], before) >= 0)
        return _pair(before[both], word[both]), text_of[both]

    sample = marked if size <= SAMPLE else marked.sample(SAMPLE / size, seed=1)
    pairs = spark.sparkContext.broadcast(_exact(marked, _common(cut(_count(sample, common_pairs)), most_pairs)[0]))

    def losses(seen: np.ndarray, seen_t: np.ndarray, single: np.ndarray, single_t: np.ndarray) -> list[np.ndarray]:
        return [_whole(-np.log(s + strength * (w + 1.0) / m)) for s, w, m in ((seen_t, single_t, mass[0]), (seen * scale, single * scale, mass[1]))]

    def contexts(n: np.ndarray, n_t: np.ndarray) -> list[np.ndarray]:
        return [_whole(np.log(x + strength)) for x in (n_t, n * scale)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k, x, h, n, m). Rare word: k has bit 62 set, x is the word before: its place in
        the broadcast, or if rare itself with bit 62 set, or -1 at a text's start. Rare pair of a common
        word: k is the pair, x the word's place. Both: n occurrences, m is twice those
        that a word follows, and one more in the target. Text: k < 0, x and m are its sums over what is
        common, n its words; equal texts of a chunk come as one row, with their number as ``copies``."""
        w_id, w_n, w_t = words.value
        p_id, p_n, p_t = pairs.value
        for batch in batches:
            for lo, hi in chunks(batch["t"]):
                part = batch.slice(lo, hi - lo)
                h = np.asarray(part["h"], np.int64)
                word, before, text_of = _words(part["t"])
                first = before == _START
                pair = _pair(before, word)
                at, prev = _find(w_id, word), np.full(len(word), -1, np.int64)
                prev[1:] = at[:-1]
                prev[first] = -1
                pair_at = _find(p_id, pair)
                pair_at[first] = -1
                own = [np.zeros(len(part), np.int64) for _ in range(2)]
                # what precedes: a text's start, or a common word
                for sums, x in zip(own, contexts(w_n[prev[prev >= 0]], w_t[prev[prev >= 0]])):
                    np.add.at(sums, text_of[prev >= 0], x)
                    np.add.at(sums, text_of[first], _whole(np.log(strength)))
                # common pairs, and common words at a text's start
                here = (pair_at >= 0) | first & (at >= 0)
                p, w = pair_at[here], at[here]
                seen = [np.where(p >= 0, x[p], 0.0) if len(x) else np.zeros(len(p)) for x in (p_n, p_t)]
                for sums, x in zip(own, losses(*seen, w_n[w], w_t[w])):
                    np.add.at(sums, text_of[here], x)
                followed = np.zeros(len(word), np.int64)
                followed[:-1] = ~first[1:]
                # the rest, once for each text that has it
                rest = np.flatnonzero(~here)
                rest = rest[np.lexsort((pair[rest], text_of[rest]))]
                new = np.ones(len(rest), bool)
                new[1:] = (pair[rest[1:]] != pair[rest[:-1]]) | (text_of[rest[1:]] != text_of[rest[:-1]])
                runs = np.flatnonzero(new)
                n = np.diff(np.append(runs, len(rest)))
                f = np.add.reduceat(followed[rest], runs) if len(runs) else np.zeros(0, np.int64)
                i = rest[runs]
                mine = part["in_target"].is_valid().to_numpy(zero_copy_only=False)
                k = np.where(at[i] < 0, word[i] | _START, pair[i]).astype(np.int64)
                x = np.where(at[i] >= 0, at[i], np.where(first[i], -1, np.where(prev[i] >= 0, prev[i], (before[i] | _START).astype(np.int64))))
                texts, one, copies = np.unique(h, return_index=True, return_counts=True)
                n_words = np.bincount(text_of, minlength=len(part))[one]
                k_text = -1 - (mix(texts.astype(np.uint64)) >> np.uint64(2)).astype(np.int64)
                columns = (
                    np.concatenate([k, k_text]), np.concatenate([x, own[0][one]]), np.concatenate([h[text_of[i]], texts]),
                    np.concatenate([n, n_words]), np.concatenate([2 * f + mine[text_of[i]], own[1][one]]), np.concatenate([np.zeros(len(i), np.int64), copies]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "x", "h", "n", "m", "copies"])

    hashed = marked.select(F.xxhash64("t").alias("h"), "t", "in_target")
    dealt = hashed.mapInArrow(deal, "k long, x long, h long, n long, m long, copies long").repartition("k")
    by_word, by_pair = Window.partitionBy("k"), Window.partitionBy("k", "x")
    in_target = F.col("n") * F.col("m").bitwiseAND(F.lit(1))
    counted = dealt.withColumns({"seen": F.sum("n").over(by_pair), "seen_t": F.sum(in_target).over(by_pair)})
    counted = counted.withColumns({"single": F.sum("n").over(by_word), "single_t": F.sum(in_target).over(by_word)})

    is_text, is_word = F.col("k") < 0, F.col("k") >= 1 << BITS
    _, w_n, w_t = words.value
    known = spark.createDataFrame(pa.table({"place": np.arange(len(w_n)), "w_n": w_n, "w_t": w_t}), "place long, w_n double, w_t double")
    counted = counted.withColumn("place", F.when(~is_text & ~is_word, F.col("x"))).join(F.broadcast(known), "place", "left")
    started = is_word & (F.col("x") == -1)
    whole = lambda c: F.rint(c * UNIT).cast("long")

    def sums(seen: str, single: str, common: str, by: float, m: float):
        alone = F.when(is_word, F.col(single)).otherwise(F.col(common)) * by
        loss = whole(-F.log(F.when(started, 0.0).otherwise(F.col(seen) * by) + strength * (alone + 1.0) / m)) * F.col("n")
        said = F.when(is_word, whole(F.log(F.col(single) * by + strength)) * F.shiftright("m", 1)).otherwise(0)
        return loss + said

    per_row = counted.select(
        "h", "copies", F.when(is_text, F.col("n")).alias("n_words"),
        F.when(is_text, F.col("x") * F.col("copies")).otherwise(sums("seen_t", "single_t", "w_t", 1.0, mass[0])).alias("t"),
        F.when(is_text, F.col("m") * F.col("copies")).otherwise(sums("seen", "single", "w_n", scale, mass[1])).alias("b"))
    # equal texts have equal sums: those of all copies are added up and shared among them
    texts = cut(per_row.groupBy("h").agg(F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"), _total("t").alias("t"), _total("b").alias("b")))
    each = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("copies") / UNIT / F.col("n_words")).otherwise(0.0)
    scored = texts.select("h", "copies", "n_words", each("t").alias("target_entropy"), each("b").alias("background_entropy"))
    new = ("n_words", "target_entropy", "background_entropy")
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*new, "score"}))
    rows = docs.select(kept.alias("row"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("h"))
    return join_spread(rows, scored, ["h"], "copies").select("row.*", *new, (F.col("target_entropy") - F.col("background_entropy")).alias("score"))


def labelled_target(labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Ids of all rows labelled 1."""
    return labels.filter(F.col(label) == 1).filter(F.col(key).isNotNull()).select(key).distinct()
