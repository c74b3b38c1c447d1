"""Ordered and vector operators against one-at-a-time twins on random logs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptlake.config import Config
from promptlake.operators.absorb import semantic_absorb
from promptlake.operators.exact_cache import l1_attribute, l1_lookup_asof
from promptlake.operators import similarity
from promptlake.operators.similarity import copies, knn, knn_lsh, recall_vs_exact, similar_pairs, similarity_matrix
from promptlake.plans.attribute import attribute_tiers

T0 = 1704067200


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))


def twin_l1(rows, ttl):
    anchor, out = {}, {}
    for rid, key, s, can in sorted(rows, key=lambda r: (r[2], r[0])):
        if key in anchor and s < anchor[key] + ttl:
            out[rid] = (True, anchor[key])
        else:
            out[rid] = (False, s if can else None)
            if can:
                anchor[key] = s
    return out


@pytest.mark.parametrize("parts", [1, 3, 20, 1440])
def test_repeats(spark, parts):
    rng = random.Random(parts)
    # one key holds a third of the rows; times repeat; gaps span several lifetimes
    rows = []
    for i in range(400):
        key = "hot" if i % 3 == 0 else rng.choice("abcdef")
        rows.append((f"{i:03}", key, T0 + rng.choice([rng.randint(0, 900), rng.randint(0, 9000), 50]), rng.random() < 0.8))
    df = frame(spark, rows, "request_id string, cache_key string, s bigint, can boolean")
    out = l1_attribute(df, ttl_s=100, can_store="can", parts=parts)
    got = {r.request_id: (r.l1_hit, r.a) for r in out.withColumn("a", F.unix_timestamp("anchor_ts")).collect()}
    assert got == twin_l1(rows, 100)


def test_one_key_inside_one_lifetime(spark):
    """All rows share a key; most lie in two lifetimes, a microsecond apart, across the moment an entry ends."""
    rng = random.Random(11)
    at = [0, *[99_999_000 + rng.randint(0, 3000) for _ in range(300)], *[200_000_000 + rng.randint(0, 3000) for _ in range(200)]]
    rows = [(f"{i:03}", None, t, rng.random() < 0.7) for i, t in enumerate(at)] + [("none", None, None, True)]
    df = spark.createDataFrame(rows, "request_id string, cache_key string, us bigint, can boolean").withColumn("ts", F.timestamp_micros("us"))
    out = l1_attribute(df, ttl_s=100, can_store="can", parts=4).withColumn("a", F.unix_micros("anchor_ts"))
    got = {r.request_id: (r.l1_hit, r.a) for r in out.collect()}
    anchor, want = None, {"none": (False, None)}
    for rid, _, t, can in sorted(rows[:-1], key=lambda r: (r[2], r[0])):
        hit = anchor is not None and t < anchor + 100_000_000
        anchor = t if can and not hit else anchor
        want[rid] = (hit, anchor if hit or can else None)
    assert got == want


def test_published_times(spark):
    rows = [(str(i), "k", T0 + s) for i, s in enumerate([0, 10, 90000, 95000, 180000])]
    df = frame(spark, rows, "request_id string, cache_key string, s bigint")
    got = [r.l1_hit for r in l1_attribute(df).orderBy("s").collect()]
    assert got == [False, True, False, True, False]


def test_asof_lookup(spark):
    rng = random.Random(2)
    req = [(str(i), rng.choice("ab"), T0 + rng.randint(0, 20000)) for i in range(120)]
    writes = [(rng.choice("ab"), f"c{i}", T0 + rng.randint(0, 20000)) for i in range(30)]
    r = frame(spark, req, "request_id string, cache_key string, s bigint")
    w = spark.createDataFrame(writes, "cache_key string, content string, w bigint").select(
        "cache_key", "content", F.timestamp_seconds("w").alias("stored_at"), F.timestamp_seconds(F.col("w") + 1500).alias("expires_at"))
    for row in l1_lookup_asof(r, w, bucket_s=700).collect():
        past = [(x[2], x[1]) for x in writes if x[0] == row.cache_key and x[2] <= row.s]
        best = max(past) if past else None
        assert row.content == (best[1] if best and row.s < best[0] + 1500 else None)


def vectors(rng, n, dim=8, distinct=None):
    base = rng.standard_normal((distinct or n, dim)).astype("float32")
    return [base[i % len(base)].tolist() for i in range(n)]


@pytest.mark.parametrize("layout", [{}, {"pivots": 5, "block_rows": 7}])
@pytest.mark.parametrize("threshold", [-1.0, 0.5])
def test_knn(spark, layout, threshold):
    rng = np.random.default_rng(4)
    q, s = vectors(rng, 40), vectors(rng, 90, distinct=30)
    s[3], s[4] = [0.0] * 8, None  # neither can be a candidate
    Q = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(q)], "request_id string, embedding array<float>")
    S = spark.createDataFrame([(f"e{i:02}", v) for i, v in enumerate(s)], "entry_id string, embedding array<float>")
    got = {(r.qid, r.rank): r.sid for r in knn(Q, S, 3, threshold, **layout).collect()}
    unit = lambda v: np.array(v, dtype="float64") / np.linalg.norm(v)
    want = {}
    for i, v in enumerate(q):
        sims = sorted((-round(float(unit(v) @ unit(e)), 6), f"e{j:02}") for j, e in enumerate(s) if e and any(e))
        for rank, (neg, sid) in enumerate([x for x in sims if -x[0] >= threshold][:3]):
            want[(f"q{i}", rank + 1)] = sid
    assert got == want


def test_pairs_with_a_crowd_of_copies(spark):
    rng = np.random.default_rng(6)
    v = vectors(rng, 30)
    v += [v[0]] * 15  # a third of all rows are copies
    df = spark.createDataFrame(list(enumerate(v)), "id bigint, embedding array<float>")
    unit = np.array(v[:30]) / np.linalg.norm(v[:30], axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = {(i, j) for i in range(30) for j in range(i) if sims[i, j] >= 0.4}
    for layout in ({}, {"pivots": 4, "block_rows": 6}):
        rows = similar_pairs(df, 0.4, **layout).collect()
        assert {(r.i, r.j) for r in rows} == want
        assert all((r.i_copies, r.j_copies) == (16 if r.i == 0 else 1, 16 if r.j == 0 else 1) for r in rows)
    assert copies(df).filter("rep = 0").count() == 16
    assert similarity_matrix(df, 0.4).count() == 2 * len(want) + 30


def test_blocks_send_a_row_a_fixed_number_of_times(spark):
    """However small the tiles, a row is dealt to no more than PARTS blocks, and pairs are whole."""
    rng = np.random.default_rng(7)
    v = np.array(vectors(rng, 1500))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, embedding array<float>")
    side = similarity._side(df, "id", "embedding", None, None)
    q, s, _ = similarity._layout(side, side, 0.9, 4, 10)
    assert q.count() <= 1500 * similarity.PARTS and s.count() <= 1500 * similarity.PARTS
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.tril(np.round(unit @ unit.T, 6) >= 0.9, -1)))}
    assert {(r.i, r.j) for r in similar_pairs(df, 0.9, pivots=4, block_rows=10).collect()} == want


def test_knn_in_time_over_tiles_and_zones(spark):
    rng = np.random.default_rng(8)
    v = vectors(rng, 120, distinct=12)  # copies, so that ties are decided by time and id
    at = [int(x) for x in rng.integers(0, 40, 120)]
    rows = [(f"r{i:03}", x, t, t + 15) for i, (x, t) in enumerate(zip(v, at))]
    rows += [("none", v[0], None, None), ("no time", v[0], None, 50), ("no end", v[0], 0, None)]
    df = spark.createDataFrame(rows,
                               "rid string, embedding array<float>, ts long, until long").select(
        "rid", "embedding", F.timestamp_seconds("ts").alias("ts"), F.timestamp_seconds("until").alias("until"))
    unit = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    want = set()
    for i in range(120):
        live = sorted((-sims[i, j], at[j], j) for j in range(120) if (at[j], j) < (at[i], i) and at[i] < at[j] + 15 and sims[i, j] >= 0.2)
        want |= {(f"r{i:03}", rank + 1, f"r{j:03}") for rank, (_, _, j) in enumerate(live[:4])}
    # the row without an end asks as any other, at its time
    old = sorted((-sims[0, j], at[j], j) for j in range(120) if at[j] == 0 and f"r{j:03}" < "no end" and sims[0, j] >= 0.2)
    want |= {("no end", rank + 1, f"r{j:03}") for rank, (_, _, j) in enumerate(old[:4])}
    for layout in ({"pivots": 0}, {"pivots": 5, "block_rows": 7}):
        got = knn(df, df, 4, 0.2, qid="rid", sid="rid", q_at="ts", s_at="ts", s_until="until", **layout).collect()
        assert {(r.qid, r["rank"], r.sid) for r in got} == want


def test_lsh_finds_most(spark):
    rng = np.random.default_rng(8)
    s = vectors(rng, 200, 16)
    q = [(np.array(v) + 0.1 * rng.standard_normal(16)).tolist() for v in s[:50]]
    Q = spark.createDataFrame([(f"q{i}", v) for i, v in enumerate(q)], "request_id string, embedding array<float>")
    S = spark.createDataFrame([(f"e{i}", v) for i, v in enumerate(s)], "entry_id string, embedding array<float>")
    r = recall_vs_exact(knn_lsh(Q, S, 1, dim=16, tables=10, bits=6, block_rows=16), knn(Q, S, 1)).first()
    assert r.expected == 50 and r.recall >= 0.9


WORDS = ["plain", "go 2024", "python", "sql 3.12", "rust 2023"]


def semantic_log(seed, n, distinct):
    """Random requests: crowds of equal vectors, equal times, several languages and numbers."""
    rng = random.Random(seed)
    base = vectors(np.random.default_rng(seed), distinct, 4)
    rows = []
    for i in range(n):
        v = 0 if rng.random() < 0.33 else rng.randrange(distinct)
        rows.append((f"{i:03}", T0 + rng.choice([rng.randint(0, 3000), 100, 200]), rng.choice(WORDS),
                     rng.choice(["en", "fr", ""]), base[v] if rng.random() < 0.95 else None,
                     rng.choice("uvw"), rng.choice("abcdefgh") if rng.random() < 0.5 else f"k{i}", rng.randint(50, 400)))
    return rows


SCHEMA = ("request_id string, s bigint, query_text string, lang string, embedding array<float>, "
          "user_id string, cache_key string, tokens_in int")


def twin_tiers(rows, t, k, ttl, quota=None, exact=True, barred=()):
    """One request at a time, as a gateway would."""
    tech = ["go", "python", "py", "sql", "rust", "ts"]
    nums = lambda x: {w for w in x.split() if w[0].isdigit()}
    techs = lambda x: {w for w in tech if w in x}
    l1, l2, used, out = {}, [], {}, {}
    for rid, s, text, lang, vec, user, key, tokens in sorted(rows, key=lambda r: (r[1], r[0])):
        if exact and key in l1 and s < l1[key] + ttl:
            out[rid] = "l1_hash"
            continue
        hit = None
        if vec is not None:
            u = np.array(vec, dtype="float32").astype("float64")
            u /= np.linalg.norm(u)
            near = sorted((-round(float(u @ e[1]), 6), e[0], e[4]) + e[2:4] for e in l2 if s < e[0] + ttl)
            for neg, at, sid, etext, elang in [x for x in near if -x[0] >= t][:k]:
                if lang and elang and lang != elang or nums(text) and nums(text) != nums(etext) or techs(text) and techs(text) != techs(etext):
                    continue
                hit = sid
                break
        if hit is not None:
            out[rid] = "l2_semantic"
            l1[key] = s
            continue
        if quota is not None and used.get(user, 0) >= quota:
            out[rid] = "rejected"
            continue
        used[user] = used.get(user, 0) + tokens + 10
        out[rid] = "llm"
        l1[key] = s
        if vec is not None:
            l2.append((s, u, text, lang, rid))
    return out


@pytest.mark.parametrize("seed, options", [
    (1, {}), (2, {"length": 3}), (3, {"slice_rows": 25}), (4, {"length": 4, "slice_rows": 20, "pivots": 4, "block_rows": 9})])
def test_absorption(spark, seed, options):
    rows = semantic_log(seed, 60, 12)
    df = frame(spark, rows, SCHEMA)
    out = semantic_absorb(df, 0.6, 3, 900, **options).collect()
    got = {r.request_id: "l2_semantic" if r.l2_hit else "llm" for r in out}
    assert got == twin_tiers(rows, 0.6, 3, 900, exact=False)
    assert len(out) == len(rows)


@pytest.mark.parametrize("seed", [11, 12])
def test_tiers_with_rejections(spark, seed):
    rows = semantic_log(seed, 70, 10)
    df = frame(spark, rows, SCHEMA).withColumns({"tokens_out": F.lit(10), "saved_units": F.lit(7).cast("bigint")})
    cfg = Config(ttl_s=900, threshold=0.6, quota=900)
    out = attribute_tiers(df, cfg).collect()
    got = {r.request_id: r.tier for r in out}
    want = twin_tiers(rows, 0.6, 3, 900, quota=900)
    assert "rejected" in want.values() and got == want
    assert len(out) == len(rows)
    assert all((r.saved_units == 7) == (r.tier in ("l1_hash", "l2_semantic")) for r in out)
