"""The training-data operators against brute force, exact round trips and held-out accuracy, and on
nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import html
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from promptlake.llm import (
    hilbert_ann, html_wrapper, langid_crf, lm_score, mixing, quality_repeats, queries, secrets, sentencepiece_fst, simhash_index, toxicity_ftrl)

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
LONG = " ".join(random.Random(3).choices([f"w{i}" for i in range(5000)], k=60_000))
ODD = [None, "", "   \n\t", "a", "x" * 70_000, LONG, "same text here now", "same text here now", "ﬁ é漢字🙂 ▁ \x00", "\n\n#$%\n#$%\n"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, r string, t int, kept string, ids string, score string"


def docs(spark, texts=ODD):
    rows = [(i, t, None, None, None, "r", 1, "k", "i", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", None, "s", None, None, None, None, None, None), *rows[6:7]], DOCS)


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def simple_quality(text):
    words = re.findall("[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i:i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked),
            n < 50 or 100 * len(marked) > 50 * n)


def test_quality_equals_brute_force(spark):
    df = docs(spark, ODD + [" ".join(random.Random(i).choices("ab", k=90)) for i in range(5)])
    rows = quality_repeats.repetition(df.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == simple_quality(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_repeats.repetition(df.limit(0)).count() == 0


def test_suffix_repeats_equal_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(30):
        words = rng.integers(0, 3, rng.integers(1, 60))
        n = len(words)
        best = [max((k for q in range(n) if q != p for k in [next((k for k in range(n) if max(p, q) + k >= n or words[p + k] != words[q + k]), n)]), default=0) for p in range(n)]
        assert quality_repeats.suffix_repeats(words, np.full(n, n)).tolist() == best


def test_quality_rejects_long_repeats(spark):
    clean = " ".join(f"u{i}" for i in range(400))
    twice = clean + " " + clean
    assert [r["kept"] for r in quality_repeats.repetition(docs(spark, [clean, twice])).filter("doc_id < 2").orderBy("doc_id").collect()] == [True, False]


def simple_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simple_components(values, radius=4):
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    return root


def test_simhash_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        docs(spark).filter("doc_id is not null").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    found = {(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash_index.near_duplicates(df).collect()}
    rows = sorted(texts_of(df))
    values = [simple_simhash(t) for _, t in rows]
    root = simple_components(values)
    assert found == {(d, v, rows[c][0]) for (d, _), v, c in zip(rows, values, root)}


def test_links_of_close_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash_index, "BLOCK", 16)  # crowded lists in blocks, also on a small table
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:6]:
        near = v
        for _ in range(12):
            for b in rng.sample(range(64), rng.choice([2, 4, 5])):
                near ^= 1 << b
            values.add(near)
    crowd = rng.getrandbits(64)
    values |= {crowd ^ i for i in range(64)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pieces = simhash_index.components(simhash_index.links(spark.createDataFrame([(v,) for v in signed], "fp long")))
    rooted = {r["node"]: r["root"] for r in pieces.collect()}
    groups = {}
    for v, c in zip(signed, simple_components(values)):
        groups.setdefault(c, set()).add(v)
    for g in groups.values():
        assert {rooted.get(v, v) for v in g} == {min(g)}


def test_keep_one(spark):
    kept = simhash_index.keep_one(docs(spark))
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 6, 8, 9] and None in ids
    assert simhash_index.keep_one(docs(spark).limit(0)).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def simple_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


SECRETS = ["secret: token: abcdefgh", "é🙂 PassWord = 'Ab12+/x_y' and api_key:\"zz\" token=token=abcdef", "AKIAAKIA" + "X" * 12 + " 0123456789abcdef01234567",
           "k " * 10 + " ".join(f"token=val{i:06d}" for i in range(700)), "password:\npasswd=12345 passwd=123456"]


def test_secret_spans_equal_brute_force(spark):
    df = docs(spark, ODD + SECRETS).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    for r in secrets.scan(df).collect():
        assert [tuple(s) for s in r["secret_spans"] if s["kind"] < 3] == simple_spans(r["text"])
    assert secrets.scan(df.limit(0)).count() == 0


def test_markov_model_and_redaction(spark):
    rng = random.Random(5)
    chars = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    key = lambda n: "".join(rng.choice(chars) for _ in range(n))
    plain = ["_".join(rng.choices(["customer", "order", "price", "update", "handler", "request", "total"], k=4)) for _ in range(300)]
    known = [f"token={key(32)} then {a}" for a in plain]
    hidden = [key(40) for _ in range(20)]
    df = docs(spark, [*known, *[f"see {h} here" for h in hidden], *[f"call {p} now" for p in plain[:50]]])
    rows = {r["doc_id"]: (r["text"], r["secret_spans"]) for r in secrets.scan(df).collect() if r["doc_id"] is not None}
    got = [[t[s["start"]:s["stop"]] for s in spans if s["kind"] == 3] for t, spans in (rows[i] for i in range(300, 320))]
    assert sum(g == [h] for g, h in zip(got, hidden)) >= 19
    assert not any(s["kind"] == 3 for i in range(320, 370) for s in rows[i][1])
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[0] == f"[secret] then {plain[0]}" and clean[330] == rows[330][0]
    assert secrets.redact(docs(spark)).filter("text is null").count() == 1


def test_base_digest(spark):
    r = next(r for r in queries.op5_secrets(spark, SF).collect() if not r["spans"])
    assert r["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_pieces_equal_library(spark):
    library = pytest.importorskip("sentencepiece")
    model = queries.piece_model()
    df = docs(spark).unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    p = library.SentencePieceProcessor(model_proto=model)
    rows = sentencepiece_fst.encode_checked(df, model).collect()
    for r in rows:
        assert r["ids"] == (None if r["text"] is None else p.encode(r["text"]))
        assert r["round_trip"] == ("▁" not in (r["text"] or ""))
    back = sentencepiece_fst.decode(sentencepiece_fst.encode(df, model, into="p"), model, "p", "again")
    assert back.filter("NOT (text <=> again) AND NOT coalesce(text, '') LIKE '%▁%'").count() == 0
    assert sentencepiece_fst.encode(df.limit(0), model).count() == 0


def test_unigram_shortest_path():
    def field(n, kind, value):
        return bytes([n << 3 | kind]) + (bytes([len(value)]) if kind == 2 else b"") + value

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("ab", -3.0, 1), ("▁ab", -5.5, 1), ("ba", -2.5, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([t]))) for p, s, t in pieces)
    m = sentencepiece_fst.Machine(model + field(2, 2, field(3, 0, b"\x01")))
    cost = {p: -s for p, s, t in pieces if t == 1}

    def best(text):
        return 0.0 if not text else min((cost[text[:k]] + best(text[k:]) for k in range(1, 4) if text[:k] in cost), default=math.inf)

    for text in ("ab", "abab", "aabba", "b ab a"):
        ids = np.frombuffer(m.encode(text), np.int32)
        assert sum(cost[m.pieces[i]] for i in ids) == best(m.normal(text)) and m.decode(ids.tolist()) == text


PAGE = """<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><nav><ul><li><a href=/>Home</a></ul></nav>
<div id=cookie-notice>We use cookies</div>{start}<h1>{title}</h1><p>One &amp; <b>two{n}<br>three</p><p>same words</p><form>mail</form>{end}
<div class="comments"><p>nice {n}</p></div><footer>&copy; site</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(start=a, end=b, title=f"Title {i}", n=i)) for i, (a, b) in enumerate([("<article>", "</article>")] * 5)]
    more = [(10, None, None), (11, "http://x.example", ""), (12, "nohost", "just &lt;text&gt; a < b"), (13, "http://y.example", "<p>cut <a hre"), (13, "http://y.example", "<p>cut <a hre"),
            (14, "http://z.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_wrapper.extract(spark.createDataFrame(rows + more, "page_id long, url string, html string")).collect()]
    text = {p: t for p, t, _ in got}
    assert len(got) == 11 and all(n == len(t) for _, t, n in got)
    # "same words" fills one slot of all five pages: template
    assert [text[i] for i in range(5)] == [f"Title {i}\n\nOne & two{i} three" for i in range(5)]
    assert tuple(text[i] for i in range(10, 15)) == ("", "", "just <text> a < b", "cut", "deep")
    assert html_wrapper.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    page = "<html><body><article><h1>{0}</h1><p>text of {0}</p></article></body></html>"
    rows = [(i, f"http://copies.example/{i}", page.format("one")) for i in range(8)]
    rows += [(10 + i, f"http://half.example/{i}", page.format("same" if i < 6 else f"other {i}")) for i in range(10)]
    # slots only the copies fill
    rows += [(30 + i, f"http://more.example/{i}", page.format("same").replace("</article>", "<p>only here</p></article>") if i < 6 else page.format(f"other {i}")) for i in range(10)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "one\n\ntext of one" for i in range(8)) and all(got[i] == "same\n\ntext of same" for i in range(10, 16))
    assert all(got[i] == "same\n\ntext of same\n\nonly here" for i in range(30, 36)) and got[39] == "other 9\n\ntext of other 9"


def test_each_common_layout_has_its_template(spark):
    one = "<html><body><div><p>we sell one</p><p>first {0}</p></div></body></html>"
    two = "<html><body><table><tr><td>we sell two<td>second {0}</table></body></html>"
    rows = [(i, f"http://host.example/{i}", (one if i < 7 else two).format(f"n{i}")) for i in range(20)] + [(20, "http://host.example/20", "<h1>not found</h1>")]
    got = {r["page_id"]: r["text"] for r in html_wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{'first' if i < 7 else 'second'} n{i}" for i in range(20)} | {20: "not found"}


def test_main_text_of_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", x)).split()) for x in re.split("</?(?:h1|p)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_tree_match():
    assert html_wrapper.tree_match("0# 1div 2p 2p 2ul 3li", "0# 1div 2p 2ul 3li 3li") == [0, 1, 2, 4, 5, -1]


def test_neighbours(spark):
    rows = queries.load(spark, SF, "embeddings")
    odd = spark.createDataFrame([(90_000, None), (90_001, []), (90_002, [float("nan")] * 64), (90_003, [0.0] * 64), (90_004, [1.0])], "vec_id long, embedding array<float>")
    same = rows.filter("vec_id = 20").select(F.explode(F.sequence(F.lit(10_020).cast("long"), F.lit(300_020).cast("long"), F.lit(10_000).cast("long"))).alias("vec_id"), "embedding")
    table = rows.select("vec_id", "embedding").unionByName(odd).unionByName(same).unionByName(rows.filter("vec_id < 9").select("vec_id", "embedding"))
    found = hilbert_ann.search(table, F.col("vec_id") % 20 == 0).collect()
    good = {r["vec_id"]: np.array(r["embedding"], float) for r in table.collect() if r["embedding"] and len(r["embedding"]) == 64 and np.isfinite(r["embedding"]).all() and any(r["embedding"])}
    hits = n = 0
    for q in (i for i in good if i % 20 == 0):
        exact = sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q))[:20]
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert [m[0] for m in mine] == list(range(1, 21)) and [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(abs(m[2] - float((good[q] * good[m[1]]).sum())) < 1e-12 for m in mine)
        hits, n = hits + len({m[1] for m in mine} & {i for _, i in exact}), n + 20
    assert hits / n >= 0.9
    assert hilbert_ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [2, 6, 10, 21, 25, 40])
def test_neighbours_in_small_tables(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(n)]
    rows += [(0, rng.normal(size=8).tolist()) for _ in range(2)]  # an id in several windows
    found = hilbert_ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()
    for q in range(n):
        assert sorted(r["rank"] for r in found if r["query_id"] == q) == list(range(1, min(20, n - 1) + 1))
        if n <= 21:
            assert {r["vec_id"] for r in found if r["query_id"] == q} == set(range(n)) - {q}


def test_hilbert_curve_steps_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert_ann.hilbert(cells, 3)
    path = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_toxicity(spark):
    got = {r["doc_id"]: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = queries.load(spark, "/root/testdata/sf0.01", "labels").collect()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for d, r in got.items())
    held = [(got[r["doc_id"]]["score"], r["toxic"]) for r in labels if got[r["doc_id"]]["held_out"]]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert np.mean(pairs) > 0.8
    none = toxicity_ftrl.train(docs(spark), queries.load(spark, SF, "labels").limit(0), F.lit(True))
    assert {r["score"] for r in toxicity_ftrl.score(docs(spark), none).collect()} == {0.5}


def test_lm_score(spark):
    a, b = "red green blue sky " * 30, "one two three four " * 30
    df = docs(spark, [a, a + "red", b, None, "", LONG])
    rows = {r["doc_id"]: r for r in lm_score.difference(df, spark.createDataFrame([(0,)], "doc_id long")).collect() if r["doc_id"] is not None}
    assert rows[1]["score"] < -0.1 < 0.1 < rows[2]["score"] and rows[3]["score"] == rows[4]["score"] == 0
    slots = lm_score.count(df, "text", spark.createDataFrame([(0,)], "doc_id long"), "doc_id", 16, 21).filter(F.col("slot") < 1 << 21)
    words = sum(len((t or "").split()) for _, t in texts_of(df))
    assert slots.agg(F.sum("n")).first()[0] == words and slots.agg(F.sum("n_target")).first()[0] == 120
    assert lm_score.difference(df.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


def simple_scores(rows, target, strength=8.0):
    """Both cross entropies of each text, from plain counts."""
    split = [re.findall("[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in rows]
    mine = [i in target for i, _ in rows]
    out = []
    models = []
    for chosen in ([w for w, m in zip(split, mine) if m], split):
        models.append((Counter(x for w in chosen for x in w), Counter(p for w in chosen for p in zip(w, w[1:]))))
    vocabulary, ours, size = len(models[1][0]), sum(models[0][0].values()), sum(models[1][0].values())
    for w in split:
        entropy = []
        for (single, pair), scale in zip(models, (1.0, ours / size if ours else 1.0)):
            mass = sum(single.values()) * scale + vocabulary
            loss = 0.0
            for i, x in enumerate(w):
                context, seen = (single[w[i - 1]] * scale, pair[w[i - 1], x] * scale) if i else (0.0, 0.0)
                loss -= math.log((seen + strength * (single[x] * scale + 1) / mass) / (context + strength))
            entropy.append(loss / max(1, len(w)))
        out.append(entropy)
    return out


@pytest.mark.parametrize("limits", [{}, {"most_words": 40, "most_pairs": 60}, {"most_words": 0, "most_pairs": 0}])
def test_lm_score_equals_plain_counts(spark, limits):
    """Also with more words than 2**16 ids can tell apart, and with most of them shuffled."""
    rng = random.Random(8)
    texts = [None, "", " ", "one", *(" ".join(rng.choices(["the", "of", *(f"v{j}" for j in range(i * 900, i * 900 + 2000))], weights=[300, 200, *[1] * 2000], k=1500)) for i in range(90))]
    texts += texts[10:13] * 3
    rows = list(enumerate(texts))
    target = set(range(4, 40)) | {95}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in lm_score.difference(df, spark.createDataFrame([(i,) for i in target], "doc_id long"), **limits).collect()}
    assert len(got) == len(rows)
    for (i, t), (ours, all_) in zip(rows, simple_scores(rows, target)):
        r = got[i]
        assert r["n_words"] == len((t or "").split()) and abs(r["target_entropy"] - ours) < 1e-6 and abs(r["background_entropy"] - all_) < 1e-6


def test_all_labelled_rows_are_the_target(spark):
    labels = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    assert lm_score.labelled_target(labels.unionByName(labels.limit(5))).count() == 60_000


def test_languages(spark):
    got = queries.op10_langid(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in queries.load(spark, SF, "documents").collect()}
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.9
    df = queries.load(spark, SF, "documents")
    model = langid_crf.train(df, F.lit(True), max_docs=150)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid_crf.predict(docs(spark, [None, "", " 123 ", "🙂", "the of and"]), model).collect()}
    assert [odd[i] for i in range(5)] == ["und"] * 4 + ["en"]
    mixed = langid_crf.word_labels(docs(spark, ["the and of to in that is was " * 5 + "der und die nicht von mit auf ist " * 5]), model).filter("doc_id = 0").first()["word_langs"]
    assert mixed[:40].count("en") > 35 and mixed[40:].count("de") > 35
    assert langid_crf.train(df.limit(0), F.lit(True)) is None


def test_chain_equals_plain_forward_backward():
    rng = np.random.default_rng(2)
    counts = np.array([5, 0, 200, 1, 64, 65])
    scores, start, trans = rng.normal(size=(counts.sum(), 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    got, expected = langid_crf.posteriors(scores, counts, start, trans)
    at, total = 0, np.zeros((3, 3))
    for n in counts:
        s = scores[at:at + n]
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        for t in range(n):
            a[t] = s[t] + (start if t == 0 else np.logaddexp.reduce(a[t - 1][:, None] + trans, axis=0))
        for t in range(n - 2, -1, -1):
            b[t] = np.logaddexp.reduce(trans + (s[t + 1] + b[t + 1])[None], axis=1)
        if n:
            z = np.logaddexp.reduce(a[-1])
            assert np.allclose(got[at:at + n], np.exp(a + b - z))
            for t in range(1, n):
                total += np.exp(a[t - 1][:, None] + trans + (s[t] + b[t])[None] - z)
        at += n
    assert np.allclose(expected, total)


def test_mixing(spark):
    counts = {"a": 1000, **{f"s{i}": 50 for i in range(10)}}
    x = mixing.choose_exponent(counts, 1500, 0.98, 4.0)
    assert 0 < x < 1 and abs(mixing.entropy(mixing.temper(counts, x)) - 0.98 * math.log(11)) < 1e-6
    y = mixing.choose_exponent(counts, 1500, 0.98, 1.5)
    assert x < y <= 1 and abs(mixing.passes(counts, mixing.temper(counts, y), 1500) - 1.5) < 1e-6
    rows = [(i, "w " * 10, "a" if i % 3 else f"s{i % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix(df, block_tokens=200).collect()
    share = Counter()
    for r in plan:
        share[r["source"]] += r["copies"] * 10
    weight = {r["source"]: r["weight"] for r in plan}
    assert all(abs(share[s] - weight[s] * 6000) <= 10 for s in weight)  # to within one document
    for s in weight:  # places tell the running sums of one permutation
        assert sorted(r["place"] for r in plan if r["source"] == s) == list(range(0, 10 * sum(r["source"] == s for r in plan), 10))
    assert mixing.take(df).count() == sum(r["copies"] for r in plan)
    assert mixing.mix(docs(spark)).count() == len(ODD) + 2 and mixing.mix(df.limit(0)).count() == 0
    assert None in [r["doc_id"] for r in mixing.take(docs(spark)).collect()]


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, sf)
    given = queries.load(spark, sf, "documents")
    fine = {d for d, t in texts_of(given) if not simple_quality(t)[5]}
    rows = out.collect()
    assert rows and {r["doc_id"] for r in rows} <= fine and all(r["round_trip"] for r in rows)
    assert not any(simple_spans(r["text"]) for r in rows)
    kinds = {simple_simhash(t) for d, t in texts_of(given) if d in {r["doc_id"] for r in rows}}
    assert len(kinds) == len({r["doc_id"] for r in rows})
    assert out.columns == [*given.columns, "n_tokens", "round_trip", "ids"]


def test_stages_on_odd_rows(spark):
    import corpus_pipeline

    odd = docs(spark, ODD + [LONG]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            assert set(odd.columns) <= set(stage(spark, df, SF).columns)
            stage(spark, df, SF).collect()


def test_tree_match_of_long_lists():
    """The best alignment at any length: 600 like paragraphs are worth more than one heading on their way."""
    from promptlake.llm.html_wrapper import tree_match

    reference, shape = ("0# " + " ".join(f"1{t}" for t in tags) for tags in (
        ["h2"] + ["p"] * 600 + ["ul"], ["ul"] + ["p"] * 400 + ["h2"] + ["p"] * 200 + ["h3"]))
    found = tree_match(reference, shape)
    assert sum(x >= 0 for x in found) == 601
    kept = [x for x in found if x > 0]
    assert kept == sorted(set(kept))
