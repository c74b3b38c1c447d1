"""Quality rules on repetition inside a text, by word suffix arrays.

The suffixes of all texts of a chunk are sorted together by prefix doubling (words of different
texts never compare equal, and only suffixes still tied are sorted again); the common prefixes of
neighbours give the longest repeat starting at each word, and the maximal repeats' spans are
united. Null text: no words. Each row is judged alone, so repeated rows and ids do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptlake.llm.batches import add_columns

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "n_covered long, longest_repeat long, kept boolean")


def suffix_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of words starting there that also starts at
    another place of its text. ``words``: ids, different for different texts; ``ends``: the end of
    each word's text, in words."""
    n = len(words)
    best = np.zeros(n, np.int64)
    if n == 0:
        return best
    order = np.argsort(words, kind="stable")
    fresh = np.ones(n, bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    levels = [rank]
    slots, k = _tied(fresh), 1
    while len(slots):
        at = order[slots]
        after = at + k
        inside = after < ends[at]
        second = np.where(inside, rank[np.minimum(after, n - 1)], -1)
        key = rank[at] * np.int64(n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        levels.append(rank)
        k *= 2
        last = np.ones(len(slots), bool)
        last[:-1] = new[1:]
        slots = slots[~(new & last)]
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[same], b[same]
    common = np.zeros(len(a), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        ok = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        ok = ok[levels[j][x[ok]] == levels[j][y[ok]]]
        common[ok] += 1 << j
    np.maximum.at(best, a, common)
    np.maximum.at(best, b, common)
    return best


def _tied(fresh: np.ndarray) -> np.ndarray:
    last = np.ones(len(fresh), bool)
    last[:-1] = fresh[1:]
    return np.flatnonzero(~(fresh & last))


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in a span."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def measure(texts: list[str | None], min_repeat: int, max_share: float, max_longest: int) -> dict[str, np.ndarray]:
    """The measures and verdicts of a chunk of texts, as columns."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    ids, base = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        seen: dict[bytes, int] = {}
        ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
        lines = [x for x in data.split(b"\n") if x.strip()]
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, SPACES))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    counts = out["n_words"]
    words = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    stops = np.cumsum(counts)
    best = suffix_repeats(words, np.repeat(stops, counts))
    text_of = np.repeat(np.arange(n), counts)

    def words_in(spans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[_covered(spans, lengths, len(words))], minlength=n)

    three, long = np.flatnonzero(best >= 3), np.flatnonzero(best >= min_repeat)
    out["n_repeat_words"] = words_in(three, np.full(len(three), 3))
    out["base_failed"] = (counts < 50) | (100 * out["n_repeat_words"] > 50 * counts)
    out["n_covered"] = words_in(long, best[long])
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], text_of, best)
    out["kept"] = ~out["base_failed"] & (out["n_covered"] <= max_share * counts) & (out["longest_repeat"] <= max_longest)
    return out


def repetition(docs: DataFrame, text: str = "text", min_repeat: int = 8, max_share: float = 0.3,
               max_longest: int = 200) -> DataFrame:
    """``docs`` with the measures of SCHEMA in place of columns of those names.

    ``kept``: the text passes the base rules, repeats of ``min_repeat`` words or more cover at most
    ``max_share`` of its words, and no repeat is longer than ``max_longest`` words.
    """
    def make(texts: pa.Array) -> dict:
        return measure(texts.to_pylist(), min_repeat, max_share, max_longest)

    return add_columns(docs, text, SCHEMA, make)
