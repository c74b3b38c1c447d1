"""Language of every word of code-switched text, by a linear-chain conditional random field.

A word's features are hashed: its beginnings and endings (letter groups that take in the blank
beside it), its letter groups of up to four bytes, and the word itself as lexicon entry. Transition
and start weights are learned with them. Forward-backward runs over whole texts: chains are cut
into segments whose transfer matrices are multiplied up, so that all segments of a chunk step
together and a very long text costs no more steps than others.

Labels come per document. They first count for every word; then words that the model, leaning to
the document's language, clearly sees in another one are relabelled, so that switches are learned.
The model is fitted by AdaGrad on a bounded sample (``max_docs`` in hash order of the id, of texts
up to ``max_chars`` characters) in one task; every text is labelled whole.

Null text or text without a letter: ``und``, score 0. No labelled rows: ``und`` for all. Ties go
to the label that sorts first. Rows are labelled alone, so repeats do no harm.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from promptlake.llm.batches import add_columns, chunks, letter_words, span_hashes

GROUPS = (1, 2, 3, 4)
SEGMENT = 64


def _groups(buf: np.ndarray, bits: int) -> list[np.ndarray]:
    """Hash of the letter group of each size that starts at each place."""
    out, h = [], np.zeros(len(buf), np.uint32)
    for n in GROUPS:
        h = h[:len(buf) - n + 1] << np.uint32(8) | buf[n - 1:]
        out.append((((h ^ np.uint32(n * 0x1F123BB5)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64))
    return out


class Features:
    """The words of a chunk of texts and their features."""

    def __init__(self, texts: pa.Array, bits: int) -> None:
        self.buf, self.starts, self.ends, self.text_of = letter_words(texts)
        self.counts = np.bincount(self.text_of, minlength=len(texts))
        self.groups = _groups(self.buf, bits) if len(self.starts) else []
        self.lexicon = (span_hashes(self.buf, self.starts, self.ends) >> np.uint64(64 - bits)).astype(np.int64) if len(self.starts) else self.starts

    def spans(self):
        """Places of each size of group, per word: (hashes, begin, end, words that have any)."""
        for n, h in zip(GROUPS, self.groups):
            begin, end = (self.starts, self.ends) if n == 1 else (self.starts - 1, self.ends + 2 - n)
            yield h, begin, end, end > begin

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = weights[self.lexicon].copy()
        for h, begin, end, some in self.spans():
            values = weights[h]
            cuts = np.stack([begin[some], np.minimum(end[some], len(h))], axis=1).ravel()
            if len(cuts) and cuts[-1] == len(h):
                cuts = cuts[:-1]
            if len(cuts):
                out[some] += np.add.reduceat(values, cuts, axis=0)[::2]
        return out

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        out = np.stack([np.bincount(self.lexicon, weights=e, minlength=size) for e in error.T], axis=1)
        for h, begin, end, some in self.spans():
            n = (end - begin)[some]
            at = np.repeat(begin[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            for k in range(error.shape[1]):
                out[:, k] += np.bincount(h[at], weights=np.repeat(error[some, k], n), minlength=size)
        return out


def posteriors(scores: np.ndarray, counts: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each label at each word of chains with ``counts`` words, and the sum of the chances
    of each transition."""
    n, k = scores.shape
    expected = np.zeros((k, k))
    if n == 0:
        return scores, expected
    full = np.flatnonzero(counts)
    per = -(-counts[full] // SEGMENT)  # segments of each chain
    first = np.concatenate([[0], np.cumsum(per)[:-1]])
    chain = np.repeat(np.arange(len(full)), per)
    nth = np.arange(per.sum()) - first[chain]
    begin = (np.cumsum(counts[full]) - counts[full])[chain] + nth * SEGMENT
    size = np.minimum(SEGMENT, counts[full][chain] - nth * SEGMENT)
    steps = int(size.max())
    place = begin[None, :] + np.arange(steps)[:, None]
    live = np.arange(steps)[:, None] < size[None, :]
    e = np.exp(np.clip(scores - scores.max(axis=1, keepdims=True), -60, 0))
    e = np.where(live[:, :, None], e[np.minimum(place, n - 1)], 1.0)
    move = np.exp(trans - trans.max())
    opens = nth == 0
    prior = np.exp(start - start.max())

    def norm(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(x.sum(axis=tuple(range(1, x.ndim)), keepdims=True), 1e-300)

    product = np.broadcast_to(np.eye(k), (len(size), k, k)).copy()
    for t in range(steps):
        step = (product if t == 0 else product @ move) * e[t][:, None, :]
        if t == 0:
            step = np.where(opens[:, None, None], step, (product @ move) * e[0][:, None, :])
        product = np.where(live[t][:, None, None], norm(step), product)
    ahead = np.ones((len(size), k)) / k
    into = np.empty((len(size), k))
    into[first] = prior / prior.sum()
    for j in range(int(per.max()) - 1):
        at = first[per > j + 1] + j
        into[at + 1] = norm(np.einsum("si,sij->sj", into[at], product[at]))
    for j in range(int(per.max()) - 1, 0, -1):
        at = first[per > j] + j
        ahead[at - 1] = norm(np.einsum("sij,sj->si", product[at], ahead[at]))
    alpha = np.empty((steps, len(size), k))
    now = into
    for t in range(steps):
        step = now @ move * e[t]
        if t == 0:
            step = np.where(opens[:, None], now * e[0], step)
        now = np.where(live[t][:, None], norm(step), now)
        alpha[t] = now
    out = np.empty((n, k))
    back = ahead
    for t in range(steps - 1, -1, -1):
        here = live[t]
        out[place[t][here]] = norm(alpha[t][here] * back[here])
        before = into if t == 0 else alpha[t - 1]
        moved = here & ~opens if t == 0 else here
        joint = before[moved][:, :, None] * move[None] * (e[t] * back)[moved][:, None, :]
        expected += norm(joint).sum(axis=0)
        back = np.where(here[:, None], norm((e[t] * back) @ move.T), back)
    return out, expected


class Model:
    def __init__(self, labels: list[str], bits: int) -> None:
        k = len(labels)
        self.labels, self.bits = labels, bits
        self.weights = np.zeros((1 << bits, k), np.float32)
        self.trans, self.start = np.eye(k) * 2.0, np.zeros(k)

    def fit(self, batches: list[tuple[Features, np.ndarray]], epochs: int, rate: float = 0.3, lean: float = 3.0, relabel_from: int = 2) -> None:
        k = len(self.labels)
        g_w, g_t, g_s = np.full(self.weights.shape, 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
        for epoch in range(epochs):
            for words, y in batches:
                if not len(words.starts):
                    continue
                scores = words.emissions(self.weights).astype(float)
                target = y[words.text_of]
                if epoch >= relabel_from:
                    leaning = scores.copy()
                    leaning[np.arange(len(target)), target] += lean
                    target = posteriors(leaning, words.counts, self.start, self.trans)[0].argmax(axis=1)
                chance, expected = posteriors(scores, words.counts, self.start, self.trans)
                error = -chance
                error[np.arange(len(target)), target] += 1.0
                same = words.text_of[1:] == words.text_of[:-1]
                seen = np.bincount(target[:-1][same] * k + target[1:][same], minlength=k * k).reshape(k, k)
                firsts = np.concatenate([[True], ~same])
                n = len(words.starts)
                grad = (words.gradient(error, len(self.weights)) / np.sqrt(n)).astype(np.float32)
                g_w += grad * grad
                self.weights += np.float32(rate) * grad / np.sqrt(g_w)
                d_t, d_s = (seen - expected) / np.sqrt(n), error[firsts].sum(axis=0) / np.sqrt(n)
                g_t += d_t * d_t
                g_s += d_s * d_s
                self.trans += rate * d_t / np.sqrt(g_t)
                self.start += rate * d_s / np.sqrt(g_s)

    def label(self, texts: pa.Array) -> tuple[Features, np.ndarray]:
        """The words of ``texts`` and the chance of each label for each word."""
        words = Features(texts, self.bits)
        if not len(words.starts):
            return words, np.zeros((0, len(self.labels)))
        return words, posteriors(words.emissions(self.weights).astype(float), words.counts, self.start, self.trans)[0]


def train(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", bits: int = 17,
          max_docs: int = 2_000, max_chars: int = 20_000, epochs: int = 6, batch_docs: int = 100) -> bytes | None:
    """A fitted model, packed; None without labelled rows."""
    rows = docs.filter(learn).select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("y"))
    rows = rows.filter(F.col("y").isNotNull() & (F.length("t") <= max_chars)).withColumn("h", F.xxhash64("k", F.length("t")))
    chosen = rows.select("h").orderBy("h").limit(max_docs)
    sample = rows.join(F.broadcast(chosen), "h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        table = table.sort_by([("h", "ascending"), ("y", "ascending")])
        labels = sorted(set(table["y"].to_pylist()))
        y = np.array([labels.index(v) for v in table["y"].to_pylist()])
        model = Model(labels, bits)
        texts = table["t"].combine_chunks()
        model.fit([(Features(texts[i:i + batch_docs], bits), y[i:i + batch_docs]) for i in range(0, len(y), batch_docs)], epochs)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = sample.select("h", "t", "y").repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(made[0]["model"]) if made else None


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: bytes | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, the label with the largest share of a text's words, and
    ``score``, that share (words counted by their chances)."""
    fitted = pickle.loads(model) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def make(texts: pa.Array) -> dict:
        m, n = shared.value, len(texts)
        if m is None:
            return {"lang_pred": ["und"] * n, "score": np.zeros(n)}
        words, chance = m.label(texts)
        sums = np.stack([np.bincount(words.text_of, weights=c, minlength=n) for c in chance.T], axis=1) if len(chance) else np.zeros((n, len(m.labels)))
        share = np.round(sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12), 9)
        best = share.argmax(axis=1)
        ascii_letter = np.bincount(words.text_of[words.buf[words.starts] < 128], minlength=n) > 0
        some = ascii_letter.copy()
        for i in np.flatnonzero(~ascii_letter):
            some[i] = _has_letter(texts[int(i)].as_py())
        return {"lang_pred": [m.labels[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist())],
                "score": np.where(some, share[np.arange(n), best], 0.0)}

    return add_columns(docs, text, "lang_pred string, score double", make)


def word_labels(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``word_langs``: the label of each letter word of a text, in order (null text: none)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.loads(model))

    def make(texts: pa.Array) -> dict:
        m = shared.value
        words, chance = m.label(texts)
        names = np.array(m.labels, object)[chance.argmax(axis=1)] if len(chance) else np.zeros(0, object)
        return {"word_langs": pa.array([x.tolist() for x in np.split(names, np.cumsum(words.counts)[:-1])], pa.list_(pa.string()))}

    return add_columns(docs, text, "word_langs array<string>", make)
