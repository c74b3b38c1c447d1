"""Main text of web pages by wrapper induction.

A page is read into a tree of its block elements. Each common layout of a host (kinds of element,
whatever their number) has a reference page; every page of the host is aligned with the one it is most
like by simple tree matching (the largest number of like-named node pairs that keep parents and
order). Aligned nodes share a slot. Over all pages of a reference the texts of each slot are compared (count, least and largest hash, combined before the shuffle): a slot that most
pages fill with one and the same text is template, one whose text varies is content. Elements that
by name, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or comments are no content anywhere.

A null page has no blocks and an empty text, as have pages of markup alone. A page without url has
the empty host. Repeated rows are each kept. Every page is read whole; trees deeper than ``DEPTH``
are flattened below it, for the alignment only.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from promptlake.llm.batches import broadcast_if_small, chunks
from promptlake.session import cut

DEPTH = 60
ALIGNMENTS = 20_000
REMEMBERED = 1_000_000  # sizes kept while two trees are aligned; what was let go is worked out again

# fixed names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select
summary table tbody td tfoot th thead title tr ul""".split())
RAW = "script style noscript template textarea iframe svg math canvas object video audio noframes xmp".split()
CLOSES_P = BLOCK - {"html", "head", "body", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head", "title"}}
SCOPE = {"table", "ul", "ol", "dl", "select", "div", "article", "section", "main", "body"}
# names of what isn't the article
OUT_TAGS = set("nav footer aside form head title select option button dialog menu search fieldset".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUT_NAMES = set("""nav navbar navigation menu menubar topbar masthead footer sidebar aside ad ads advert adverts advertisement adsense
advertorial banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe
subscription signup login signin search searchbox breadcrumb breadcrumbs pagination pager share sharing social related recommended
recommendations comment comments commentlist disqus discussion respond reply replies toolbar skiplink copyright legal widget alert
paywall""".split())
HEAD_NAMES = set("header head".split())
MAIN_NAMES = set("content main article post entry story maincontent articlebody postbody entrycontent bodytext".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})\b[^>]*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)(?:>|\Z)",
    re.S | re.I)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
WORDS = re.compile(r"[a-z]+")


class Page:
    """Block elements of a page: tag and parent of each, and the blocks of text in page order."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.out = ["#"], [-1], [False]
        self.main: list[int] = []
        self.texts: list[tuple[int, str, bool]] = []  # node, text, all of it links
        self._read(source)

    def _node(self, tag: str, attrs: str, parent: int) -> int:
        out, within = self.out[parent], bool(self.main) and self._inside(parent)
        hidden, names = False, set()
        if attrs:
            for name, a, b, c, flag in ATTR.findall(attrs):
                name, value = name.lower(), (a or b or c).lower()
                if flag or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    hidden = True
                elif name == "role":
                    hidden = hidden or value in OUT_ROLES
                    names |= {"main"} if value == "main" else set()
                elif name in ("class", "id"):
                    names |= set(WORDS.findall(value))
                    names |= {x.replace("-", "").replace("_", "") for x in value.split()} & (MAIN_NAMES | OUT_NAMES)
        if tag not in ("html", "body", "main"):
            out = out or hidden or tag in OUT_TAGS or bool(names & OUT_NAMES) and not (tag == "article")
            out = out or not within and tag != "article" and (tag == "header" or bool(names & HEAD_NAMES))
        self.tags.append(tag)
        self.parents.append(parent)
        self.out.append(out)
        node = len(self.tags) - 1
        if not out and not within and (tag in ("article", "main") or tag in ("div", "section", "td") and names & MAIN_NAMES):
            self.main.append(node)
        return node

    def _inside(self, node: int) -> bool:
        while node > 0:
            if node in self.main:
                return True
            node = self.parents[node]
        return False

    def _read(self, source: str) -> None:
        stack, run, links, linked = [0], [], 0, True
        at = 0

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                run.clear()
                if text:
                    self.texts.append((stack[-1], text, linked))
            linked = True

        for m in TOKEN.finditer(source):
            if m.start() > at:
                piece = source[at:m.start()]
                run.append(piece)
                linked = linked and (links > 0 or not piece.strip())
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag not in BLOCK:
                if tag == "a":
                    links = max(0, links - 1) if m["end"] else links + 1
                elif tag in ("br", "wbr"):
                    run.append(" " if tag == "br" else "")
                continue
            flush()
            if m["end"]:
                if tag in (self.tags[n] for n in stack[1:]):
                    while self.tags[stack.pop()] != tag:
                        pass
                continue
            if tag in CLOSES_P and self.tags[stack[-1]] == "p":
                stack.pop()
            ends = ENDED_BY.get(tag)
            if ends:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[depth]] in ends:
                        del stack[depth:]
                        break
                    if self.tags[stack[depth]] in SCOPE:
                        break
            node = self._node(tag, m["attrs"], stack[-1])
            if tag not in VOID:
                stack.append(node)
        if at < len(source):
            run.append(source[at:])
            linked = linked and (links > 0 or not source[at:].strip())
        flush()

    def shape(self) -> str:
        """The tree without its texts: depth and tag of each node."""
        depth = [0]
        for p in self.parents[1:]:
            depth.append(min(DEPTH, depth[p] + 1))
        return " ".join(f"{d}{t}" for d, t in zip(depth, self.tags))

    def blocks(self) -> list[tuple[int, str, bool]]:
        """(node, text, whether it can be content) in page order. Where a page names its article,
        all else is out; elsewhere lists of links are."""
        if self.main:
            inside = [False] * len(self.tags)
            for n in range(1, len(self.tags)):
                inside[n] = n in self.main or inside[self.parents[n]]
            return [(n, t, inside[n] and not self.out[n]) for n, t, _ in self.texts]
        return [(n, t, not self.out[n] and not (linked and self.tags[n] in ("li", "ul", "ol", "td", "dd", "div", "#"))) for n, t, linked in self.texts]


class _Tree:
    def __init__(self, shape: str) -> None:
        self.tags, self.children, stack = [], [], []
        for i, part in enumerate(shape.split(" ")):
            d = int(re.match(r"\d+", part)[0])
            self.tags.append(part[len(str(d)):])
            self.children.append([])
            del stack[d:]
            if stack:
                self.children[stack[-1]].append(i)
            stack.append(i)
        self.forms = [""] * len(self.tags)
        for i in range(len(self.tags) - 1, -1, -1):
            self.forms[i] = f"{self.tags[i]}({' '.join(self.forms[c] for c in self.children[i])})" if self.children[i] else self.tags[i]


class _Siblings:
    """Best in-order alignment of two lists of kinds, of which any two match with a weight. One row of
    the table is worked out at a time and only some rows are kept; the way back opens those between
    again, so that memory grows with the square root of one list times the other."""

    def __init__(self, x: list[int], y: list[int], weight: Callable[[int, int], int]) -> None:
        self.x, self.weight = x, weight
        self.kinds, self.at = np.unique(np.array(y), return_inverse=True)
        self.rows: dict[int, np.ndarray] = {}

    def _next(self, above: np.ndarray, kind: int) -> np.ndarray:
        if kind not in self.rows:
            if len(self.rows) * len(self.kinds) >= REMEMBERED:
                self.rows.clear()
            self.rows[kind] = np.array([self.weight(kind, k) for k in self.kinds.tolist()], dtype=np.int64)
        row = above.copy()
        np.maximum(row[1:], above[:-1] + self.rows[kind][self.at], out=row[1:])
        return np.maximum.accumulate(row, out=row)

    def total(self) -> int:
        row = np.zeros(len(self.at) + 1, dtype=np.int64)
        for kind in self.x:
            row = self._next(row, kind)
        return int(row[-1])

    def pairs(self) -> list[tuple[int, int]]:
        step = math.isqrt(len(self.x)) + 1
        row, kept = np.zeros(len(self.at) + 1, dtype=np.int64), []
        for i, kind in enumerate(self.x):
            if i % step == 0:
                kept.append(row)
            row = self._next(row, kind)
        got, j = [], len(self.at)
        for first in range((len(kept) - 1) * step, -1, -step):
            table = [kept.pop()]
            for kind in self.x[first:first + step]:
                table.append(self._next(table[-1], kind))
            i = len(table) - 1
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    got.append((first + i, j))
        return got


def tree_match(reference: str, shape: str) -> list[int]:
    """Simple tree matching: for each node of ``shape`` the node of ``reference`` aligned with it, or -1."""
    a, b = _Tree(reference), _Tree(shape)
    numbers: dict[str, int] = {}
    of_a, of_b = ([numbers.setdefault(f, len(numbers)) for f in tree.forms] for tree in (a, b))
    # trees of one form are alike in all that follows; one of each stands for them
    some_a, some_b = dict(zip(of_a, range(len(of_a)))), dict(zip(of_b, range(len(of_b))))
    sizes: dict[tuple[int, int], int] = {}

    def between(x: list[int], y: list[int]) -> tuple[int, int]:
        """How many siblings are of like form at the start and at the end. Pairing those at once cannot
        lose matches; only what lies between needs the table."""
        least, lo, hi = min(len(x), len(y)), 0, 0
        while lo < least and of_a[x[lo]] == of_b[y[lo]]:
            lo += 1
        while hi < least - lo and of_a[x[-1 - hi]] == of_b[y[-1 - hi]]:
            hi += 1
        return lo, hi

    def siblings(x: list[int], y: list[int]) -> _Siblings:
        return _Siblings([of_a[n] for n in x], [of_b[n] for n in y], size)

    def size(form_a: int, form_b: int) -> int:
        p, q = some_a[form_a], some_b[form_b]
        if a.tags[p] != b.tags[q]:
            return 0
        n = sizes.get((form_a, form_b))
        if n is None:
            x, y = a.children[p], b.children[q]
            lo, hi = between(x, y)
            n = 1 + sum(size(of_a[i], of_b[j]) for i, j in zip(x[:lo] + x[len(x) - hi:], y[:lo] + y[len(y) - hi:]))
            x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
            if x and y:
                n += siblings(x, y).total()
            if len(sizes) >= REMEMBERED:
                sizes.clear()
            sizes[form_a, form_b] = n
        return n

    out = [-1] * len(b.tags)
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        out[q] = p
        x, y = a.children[p], b.children[q]
        lo, hi = between(x, y)
        todo += zip(x[:lo] + x[len(x) - hi:], y[:lo] + y[len(y) - hi:])
        x, y = x[lo:len(x) - hi], y[lo:len(y) - hi]
        if x and y:
            todo += [(x[i], y[j]) for i, j in siblings(x, y).pairs()]
    return out


_ALIGNED: dict[tuple[str, str], list[int]] = {}


def _align(reference: str, shape: str) -> list[int]:
    found = _ALIGNED.get((reference, shape))
    if found is None:
        if len(_ALIGNED) >= ALIGNMENTS:
            _ALIGNED.clear()
        found = _ALIGNED[reference, shape] = tree_match(reference, shape)
    return found


def layout(shape: str) -> str:
    """The kinds of element of a tree with their ancestors, however often each occurs: pages that
    differ only in their numbers of paragraphs or list items have the same."""
    path, seen = [], set()
    for part in shape.split(" "):
        d = int(re.match(r"\d+", part)[0])
        del path[d:]
        path.append(part)
        seen.add("/".join(path[-4:]))
    return " ".join(sorted(seen))


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in chunks(batch["html"]):
            part = batch.slice(lo, hi - lo)
            found = [xxhash.xxh64_intdigest(layout(Page(x).shape())) >> 1 for x in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["host"], part["h"], pa.array(found, pa.int64())], ["host", "h", "layout"])


def _best(references: list[dict], shape: str) -> tuple[int, list[int]]:
    """Number of the reference that most of the page is aligned with, and the alignment. A page
    of a reference's own layout is aligned with that one."""
    own = xxhash.xxh64_intdigest(layout(shape)) >> 1 if len(references) > 1 else None
    some = [i for i, r in enumerate(references) if r["layout"] == own] or range(len(references))
    best, most = (-1, []), -1.0
    for i in some:
        aligned = _align(references[i]["shape"], shape)
        like = 2 * sum(x >= 0 for x in aligned) / (len(aligned) + references[i]["shape"].count(" ") + 1)
        if like > most:
            best, most = (i, aligned), like
    return best


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch["host"], batch["layout"], pa.array([Page(h or "").shape() for h in batch["html"].to_pylist()], pa.string())], ["host", "layout", "shape"])


BLOCKS = "array<struct<slot:int,hash:long,content:boolean,text:string>>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("content", pa.bool_()), ("text", pa.string())]))
    for batch in batches:
        for lo, hi in chunks(batch["html"]):
            part = batch.slice(lo, hi - lo)
            rows, chosen = [], []
            for source, references in zip(part["html"].to_pylist(), part["references"].to_pylist()):
                page = Page(source or "")
                ref, aligned = _best(references, page.shape()) if references else (-1, [-1] * len(page.tags))
                chosen.append(ref)
                # only what can be content is kept and compared
                rows.append([{"slot": aligned[n], "hash": xxhash.xxh64_intdigest(t) >> 1, "content": True, "text": t} for n, t, ok in page.blocks() if ok])
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], part["host"], pa.array(chosen, pa.int32()), pa.array(rows, kind)], ["page_id", "url", "host", "ref", "blocks"])


def extract(pages: DataFrame, least_pages: int = 5, share: float = 0.5, most_layouts: int = 8) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_template): main text of every row of ``pages``.

    A slot is template if at least ``least_pages`` and ``share`` of the different contents of
    its reference's pages fill it, all with the same text. A page of nothing but such slots keeps them.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url").alias("h"))
    shaped = rows.filter(F.length("html") > 0).select("host", "h", "html").mapInArrow(_layouts, "host string, h long, layout long")
    counted = cut(shaped.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("h").alias("h")))
    # the commonest layouts of a host, and one where none is common
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "layout"))
    common = counted.filter(f"n >= {least_pages}").withColumn("place", place).filter(F.col("place") <= most_layouts).drop("place")
    first = counted.groupBy("host").agg(F.max_by(F.struct("layout", "n", "h"), F.struct("n", -F.col("layout"))).alias("x")).select("host", "x.layout", "x.n", "x.h")
    chosen = cut(common.union(first).select("host", "layout", "h").distinct())
    sources = rows.select("host", "h", "html").join(broadcast_if_small(chosen), ["host", "h"])
    shapes = sources.groupBy("host", "layout").agg(F.min("html").alias("html")).mapInArrow(_shapes, "host string, layout long, shape string")
    references = cut(shapes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("layout", "shape"))).alias("references")))
    joined = rows.join(broadcast_if_small(references), "host", "left").select("page_id", "url", "host", "html", "references")
    held = f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, host string, ref int, blocks {BLOCKS}"
    read = cut(joined.withColumn("url", F.col("url").cast("string")).mapInArrow(_blocks, held))
    # copies of a page tell no more about its host than the page itself
    content = F.xxhash64(F.col("blocks")["hash"]).alias("content")
    sizes = read.select("host", "ref", content).distinct().groupBy("host", "ref").agg(F.count("*").alias("pages"))
    slots = read.select("host", "ref", content, F.explode(F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), b["hash"].alias("hash")))).alias("b"))
    fixed = cut(
        slots.select("host", "ref", "content", "b.slot", "b.hash").distinct()
        .groupBy("host", "ref", "slot").agg(F.count("*").alias("n"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        .filter(f"slot >= 0 AND lo = hi AND n >= {least_pages}").join(sizes, ["host", "ref"]).filter(F.col("n") >= share * F.col("pages"))
        .groupBy("host", "ref").agg(F.collect_set("slot").alias("fixed")))  # slots of one reference page
    varied = F.filter("blocks", lambda b: F.col("fixed").isNull() | ~F.array_contains("fixed", b["slot"]))
    kept = F.when(F.size(varied) > 0, varied).otherwise(F.col("blocks"))  # no page is emptied
    done = read.join(broadcast_if_small(fixed), ["host", "ref"], "left").select("page_id", "url", "blocks", kept.alias("kept"))
    text = F.array_join(F.transform("kept", lambda b: b["text"]), "\n\n")
    return done.select(
        "page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"),
        F.size("kept").alias("n_blocks"), (F.size("blocks") - F.size("kept")).alias("n_template"))
