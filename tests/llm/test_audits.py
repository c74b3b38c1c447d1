"""Filter audit, source divergence and odd sketches against brute force and their SQL, and on odd rows."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.llm import filter_audit, odd_sketch, source_divergence

DOCS = "doc_id long, text string, lang string, source string, digest string, n int, part string, key string, node long"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    """(id, text, lang, source) with further columns whose names occur inside the operators."""
    return spark.createDataFrame([(*r, "d", 7, "p", "k", 9) for r in rows], DOCS)


def odd_rows():
    rng = random.Random(5)
    base = [None, "", " \n\t", "a", "A", "a b", "B A", "#", "É é漢🙂 x", "Same Text here", "Same Text here", "x" * 50_000,
            " ".join(rng.choices([f"w{i}" for i in range(400)], k=30_000)), " ".join(["AB cd"] * 150), " ".join(f"v{i}" for i in range(250))]
    rows = [(i, t, rng.choice(["en", None, "", "de"]), rng.choice([None, "", "s1", "s2"])) for i, t in enumerate(base)]
    rows += [(40 + i, " ".join(rng.choices(["Aa", "b#", "cc", "dé", "e1f"], k=rng.randint(1, 260))), rng.choice(["en", "de"]), f"s{rng.randint(0, 3)}") for i in range(60)]
    return [*rows, (None, "no id", "en", "s1"), (None, None, None, None), rows[9], rows[40], (9, "another text", "en", "s1")]


def plain_audit(rows, labels):
    seen, masks = defaultdict(list), []
    for i, t, _, _ in rows:
        if i is not None:
            seen[t or ""].append(i)
    for i, t, _, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 i is not None and min(seen[t]) < i)
        masks.append((s or "", {f for f, bad in zip("ABCDE", fails) if bad}, labels.get(i, (0, 0))))
    out, shares = {}, Counter()
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = sum(f in m[1] for m in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in own), sum(m[2][0] == 1 for m in gone), sum(m[2][1] == 1 for m in gone)]
                shares[part, f] += len(gone)
    return {k: (*v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "CHUNK", 500)
    monkeypatch.setattr(filter_audit, "SHARD", 2000)
    rows = odd_rows()
    labels = {0: (1, 0), 9: (0, 1), 41: (1, 1), 45: (1, 0), 10: (None, 1)}
    marks = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(41, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in filter_audit.audit(table(spark, rows), marks).collect()}
    assert found == plain_audit(rows, labels)
    assert filter_audit.audit(table(spark, rows).limit(0), marks).count() == 0


def test_matrix_columns_are_those_of_one_dictionary(spark):
    rows = [(i, f"w{i % 3} w{i % 5} x", "en", "s") for i in range(40)]
    shards = filter_audit.csr_shards(table(spark, rows).repartition(4)).collect()
    assert len(shards) > 1
    owned = {s["shard"]: {i: (s["shard"], i) for i in range(s["n_own"])} | {c["at"]: (c["owner"], c["number"]) for c in s["columns"]} for s in shards}
    assert len({c for own in owned.values() for c in own.values()}) == 6
    assert sum(sum(s["data"]) for s in shards) == 120


def plain_divergence(rows, least, top):
    df, n = Counter(), Counter()
    for _, t, l, s in rows:
        words = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        df.update((l or "", w) for w in set(words))
        n.update((l or "", s or "", w) for w in words)
    groups = {(r[2] or "", r[3] or "") for r in rows}
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [w for (l, w), c in df.items() if l == lang and c >= least]
        of = {s: {w: n[lang, s, w] for w in kept} for l, s in groups if l == lang}
        whole = {w: sum(c[w] for c in of.values()) for w in kept}
        p = lambda c, w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in of.items():
            pairs = sorted(((-sum(apart(p(c, w), p(d, w)) for w in kept), o.encode(), o) for o, d in of.items() if o != s))
            terms = sorted(((-apart(p(c, w), p(whole, w)), w.encode(), w) for w in kept if c[w] and p(c, w) > p(whole, w)))
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("bits", [64, 4])
def test_source_divergence_equals_brute_force(spark, monkeypatch, bits):
    """Also where a digest of four bits stands for many terms, and in blocks of few terms and sources."""
    monkeypatch.setattr(source_divergence, "TERMS", 7)
    monkeypatch.setattr(source_divergence, "SOURCES", 3)
    rng = random.Random(2)
    words = [f"{c}{d}" for c in "abcdeéÉ" for d in "AbÉ漢zy"]
    rows = odd_rows() + [(100 + i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randint(0, 40))), rng.choice(["en", "de", "x"]), f"s{rng.randint(0, 9)}")
                         for i in range(150)]
    df = table(spark, rows)
    found = [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in source_divergence.audit(df, least=3, top=4, bits=bits).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergence(rows, 3, 4)
    assert source_divergence.audit(df.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    n, total, terms = 8 * 10**14, 3 * 10**15 + 1, 10**9 + 7
    row = spark.range(1).select(source_divergence.share(F.lit(n), F.lit(total), F.lit(terms)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * terms)


def plain_near(rows, percent=80):
    sets = []
    for _, t, _, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[top(i)].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(sets[i]), least[top(i)], r[0] == least[top(i)]) for i, r in enumerate(rows))


def near_rows():
    """Families whose members differ in more and more words, around the border too."""
    rng = random.Random(9)
    rows = odd_rows()
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(rng.choice([3, 6, 12, 40, 150, 400]))]
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 9))):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((1000 + len(rows), " ".join(words), "en", "s"))
    return rows


@pytest.mark.parametrize("block, first", [(2048, 8), (4, 1)])
def test_odd_sketch_equals_brute_force(spark, monkeypatch, block, first):
    """Also in blocks of four, and from one partner per member on."""
    monkeypatch.setattr(odd_sketch, "BLOCK", block)
    monkeypatch.setattr(odd_sketch, "FIRST", first)
    rows = near_rows()
    df = table(spark, rows)
    found = Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in odd_sketch.near_duplicates(df).collect())
    assert found == plain_near(rows)


def test_odd_sketch_stores_no_pairs_of_a_group(spark, monkeypatch):
    """Twice the members of a group of near copies, many of them at a similarity of 0.6 to 0.8, must
    not store many more than twice the rows."""
    stored, cut = [], odd_sketch.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(odd_sketch, "cut", counted)
    rng = random.Random(3)
    rows = [(i, " ".join(f"n{rng.randrange(10**6)}" if rng.random() < 0.002 * (i % 100) else f"w{k}" for k in range(200)), "en", "s") for i in range(400)]
    most = []
    for n in (200, 400):
        stored.clear()
        found = odd_sketch.near_duplicates(table(spark, rows[:n])).collect()
        assert Counter(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in found) == plain_near(rows[:n])
        most.append(max(stored))
    assert most[1] < 2.5 * most[0] and most[1] < 10 * len(rows)


def test_odd_sketch_keeps_one_of_each(spark):
    df = table(spark, odd_rows())
    kept = odd_sketch.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id < 12").collect())
    assert ids == [0, 1, 2, 3, 5, 6, 7, 8, 9, 9, 9, 11]  # three rows have the id 9
    assert odd_sketch.near_duplicates(df.limit(0)).count() == 0 and odd_sketch.keep_one(df.limit(0)).count() == 0


def test_samples_and_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    for size in (5, 50, 300, 4000):
        agree, estimates = [], []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            one = np.sort(np.append(both, rng.integers(0, 1 << 63, size // 5, dtype=np.uint64)))  # similarity 5/6
            found = odd_sketch.samples(np.concatenate([np.sort(both), one]), np.array([0, size, size + len(one)]))
            agree.append((found[0] == found[1]).mean())
            flips = int(np.bitwise_count(np.bitwise_xor(*odd_sketch.fold(found)).view(np.uint64)).sum())
            estimates.append(odd_sketch.similarity_of(flips))
            assert flips <= odd_sketch.most_flips(0.8)
        true = size / (size + size // 5)
        assert abs(np.mean(agree) - true) < 0.03 and abs(np.mean(estimates) - true) < 0.05


@pytest.mark.parametrize("operator, sql", [(lambda d, l: filter_audit.audit(d, l), filter_audit.SQL), (lambda d, l: source_divergence.audit(d), source_divergence.SQL),
                                           (lambda d, l: odd_sketch.near_duplicates(d), odd_sketch.SQL)], ids=["filters", "divergence", "near"])
def test_equals_sql(spark, operator, sql):
    rows = {(r[0], r[1]): r for r in odd_rows()}
    rows = [r for i, r in enumerate({r[0]: r for r in rows.values() if r[0] is not None}.values())]
    d = table(spark, rows)
    l = spark.createDataFrame([(3, 1, 0), (44, 1, 1)], "doc_id long, quality int, toxic int")  # noqa: E741
    con = duckdb.connect()
    con.register("documents", d.toArrow())
    con.register("labels", l.toArrow())
    want = con.sql(sql)
    names = sorted(want.columns)
    found = operator(d, l)
    assert sorted(found.columns) == names
    assert Counter(found.select(*names).toPandas().itertuples(index=False, name=None)) == Counter(want.df()[names].itertuples(index=False, name=None))
