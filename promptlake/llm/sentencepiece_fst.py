"""SentencePiece encoding and decoding as shortest paths of a composed transducer.

A model file is compiled into a normaliser (rewrite rules, white space to U+2581, prefix), an
acceptor of pieces, and byte fallback for characters outside the pieces. A text composed with them
is a lattice of pieces, whose shortest path in the tropical semiring is the encoding. The weights
are those of the model: negative log probabilities for unigram models; for merge (BPE) models a
pair of neighbouring pieces costs nothing if merging their joint string gives that very pair, and
infinity otherwise, so the one path of finite cost is the merge encoding.

Where no piece can reach over a place (before U+2581 after another character, around characters
without longer pieces) every path passes through one state: the lattice falls apart into words,
whose paths are kept in a bounded cache. A long text without such places is one lattice, walked in
time proportional to its length.

Null text gives null ids and null text; an empty text gives no ids. Repeated rows give the same ids.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from promptlake.llm.batches import add_columns

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE = 1 << 19
INF = float("inf")


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            value = data[at:at + size]
            at += size
        yield tag >> 3, value


class Machine:
    """A compiled model."""

    def __init__(self, model: bytes, rules: dict[str, str] | None = None) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for n, value in _fields(model):
            if n == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif n == 2:
                trainer = dict(_fields(value))
            elif n == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if normalizer.get(2):
            raise ValueError("models with a compiled character map are not supported: pass its rules")
        self.prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.rules = dict(rules or {})
        self._rule = re.compile("|".join(map(re.escape, sorted(self.rules, key=len, reverse=True)))) if self.rules else None
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = self.types.index(UNKNOWN) if UNKNOWN in self.types else 0
        self.longest = max(map(len, self.ids), default=1)
        self.lost = min(self.scores, default=0.0) - 10.0
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._words = None if crossing else re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        self._surface = [self._bytes_of(i) for i in range(len(self.pieces))]
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._paths: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # the paths of the last full cache; those in use move on
        self._ends: dict = {}  # pieces read backwards: a node for each character, the id under ""
        for piece, i in self.ids.items() if self.kind == BPE else ():
            node = self._ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = i

    def _bytes_of(self, i: int) -> bytes:
        if self.types[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.types[i] == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if self.types[i] == CONTROL else self.pieces[i].replace(SPACE, " ").encode()

    def normal(self, text: str) -> str:
        if self._rule:
            text = self._rule.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return text
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def _merges_to(self, text: str, border: int) -> bool:
        """Whether merging ``text`` (best joint piece first, leftmost of equals) ends as the pieces
        before and after place ``border``; 0: as one piece. Stops at the first merge over the border."""
        ids, scores = self.ids, self.scores

        def score(a: str, b: str) -> float:
            k = ids.get(a + b)
            return -INF if k is None else scores[k]

        parts = list(text)
        places = list(range(len(parts)))
        gains = [score(parts[i], parts[i + 1]) for i in range(len(parts) - 1)]
        while gains:
            best = max(gains)
            if best == -INF:
                break
            i = gains.index(best)
            if places[i + 1] == border:
                return False
            parts[i] += parts.pop(i + 1)
            places.pop(i + 1)
            gains.pop(i)
            if i < len(gains):
                gains[i] = score(parts[i], parts[i + 1])
            if i:
                gains[i - 1] = score(parts[i - 1], parts[i])
        return len(parts) == (2 if border else 1)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the pair of pieces has a finite weight; a < 0: b comes first."""
        if a < 0:
            ok = self._whole.get(b)
            if ok is None:
                ok = self._whole[b] = self._merges_to(self.pieces[b], 0)
            return ok
        ok = self._pairs.get((a, b))
        if ok is None:
            x, y = self.pieces[a], self.pieces[b]
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            ok = self._pairs[a, b] = self._merges_to(x + y, len(x))
        return ok

    def _path(self, word: str) -> list[int]:
        """Ids on the shortest path; characters without a piece as -1 - code point."""
        return self._merge_path(word) if self.kind == BPE else self._cheapest_path(word)

    def _merge_path(self, word: str) -> list[int]:
        """The one path of finite weight. Every beginning of a word has one, too, so one state for
        each place is enough."""
        n = len(word)
        ends, pair = self._ends, self._pairs.get
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            found = []  # pieces that end here, shortest first
            node, j = ends, i
            while j:
                j -= 1
                node = node.get(word[j])
                if node is None:
                    break
                k = node.get("")
                if k is not None:
                    found.append((j, k))
            for j, k in reversed(found):
                before = last[j]
                ok = pair((before, k))
                if self._fits(before, k) if ok is None else ok:
                    last[i], size[i] = k, i - j
                    break
            else:
                last[i], size[i] = -1 - ord(word[i - 1]), 1
        return self._trace(last, size)

    def _cheapest_path(self, word: str) -> list[int]:
        n = len(word)
        cost, last, size = [0.0] + [INF] * n, [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - self.longest), i):
                k = self.ids.get(word[j:i])
                if k is not None and cost[j] - self.scores[k] < cost[i]:
                    cost[i], last[i], size[i] = cost[j] - self.scores[k], k, i - j
            if word[i - 1] not in self.ids and cost[i - 1] - self.lost < cost[i]:
                cost[i], last[i], size[i] = cost[i - 1] - self.lost, -1 - ord(word[i - 1]), 1
        return self._trace(last, size)

    @staticmethod
    def _trace(last: list[int], size: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        out = []
        for k in self._path(word):
            if k >= 0:
                out.append(k)
            elif self.bytes:
                out.extend(self.bytes[b] for b in chr(-1 - k).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as 32-bit numbers."""
        line = self.normal(text)
        if self._words is None or self.unknown and not self.bytes:
            return self.word_ids(line)
        words = self._words.findall(line)
        paths = self._paths
        try:
            return b"".join([paths[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            ids = paths.get(w)
            if ids is None:
                ids = self._older.get(w)
                if ids is None:
                    ids = self.word_ids(w)
                if len(w) <= 64:
                    if len(paths) >= CACHE:
                        self._older = paths
                        paths = self._paths = {}
                    paths[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        surface = self._surface
        out = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


_MACHINES: dict[str, Machine] = {}


def machine(model: bytes, rules: dict[str, str] | None = None) -> Machine:
    """The compiled model, kept by the worker between tasks."""
    name = hashlib.md5(model + repr(sorted((rules or {}).items())).encode()).hexdigest()
    if name not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[name] = Machine(model, rules)
    return _MACHINES[name]


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(packed: list[bytes | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 if x else 0 for x in packed)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in packed]))


def encode(docs: DataFrame, model: bytes, text: str = "text", into: str = "ids", rules: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``into``."""

    def make(texts: pa.Array) -> dict:
        m = machine(model, rules)
        return {into: _lists([None if t is None else m.encode(t) for t in texts.to_pylist()])}

    return add_columns(docs, text, f"`{into}` array<int>", make)


def encode_checked(docs: DataFrame, model: bytes, text: str = "text", rules: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, ``n_tokens`` (null text: null, 0) and ``round_trip``: whether decoding
    gives back the text as normalised."""

    def make(texts: pa.Array) -> dict:
        m = machine(model, rules)
        rows = texts.to_pylist()
        packed = [None if t is None else m.encode(t) for t in rows]
        same = [True if t is None else m.decode(np.frombuffer(p, np.int32).tolist()) == t for t, p in zip(rows, packed)]
        return {"ids": _lists(packed), "n_tokens": np.array([len(p or b"") // 4 for p in packed], np.int64), "round_trip": np.array(same, bool)}

    return add_columns(docs, text, "ids array<int>, n_tokens long, round_trip boolean", make)


def decode(docs: DataFrame, model: bytes, ids: str = "ids", into: str = "text") -> DataFrame:
    """``docs`` with the text of the list of ``ids`` in ``into``; null or empty pieces give null or ''."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def to_text(lists):
        m = machine(model)
        return lists.map(lambda x: None if x is None else m.decode(list(x)), na_action=None)

    return docs.withColumn(into, to_text(F.col(f"`{ids}`")))
