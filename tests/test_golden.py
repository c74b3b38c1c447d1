"""Published examples of the scalar rules."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from promptlake import Rules
from promptlake.functions import cost, keys, quota, text as T, validate as V
from promptlake.functions.vector import cosine_sim
from promptlake.operators.ordered import order_statistics, running_sum, trailing_mean
from promptlake.operators.quota import quota_gate
from promptlake.operators.truncate import truncate_stream
from promptlake.operators.metrics import histogram_quantile
from promptlake.rules import load_rules, rule_frames


def col(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_tokens_and_cost(spark):
    assert col(spark, ["hello", "안녕하세요", "", "Redis란 무엇인가?", "파이썬 버블소트 코드 짜줘"],
               cost.estimate_tokens("v")) == [1, 3, 1, 5, 9]
    pairs = spark.createDataFrame([(100, 200), (10, 20), (5, 10), (439, 57)], "a int, b int")
    assert [r[0] for r in pairs.select(cost.cost_usd("a", "b")).collect()] == [0.00035, 0.000035, 0.0000175, 0.000305]
    assert col(spark, [150, 400, 800, 1200], cost.token_limit("v"), "int") == [225, 600, 1200, 1800]


def test_classes(spark):
    texts = ["파이썬 설치 단계별 가이드", "버블 정렬 코드 짜줘", "오버피팅 설명해줘", "안녕", "코드 작성 방법"]
    assert col(spark, texts, T.classify_query("v")) == ["VERY_LONG", "LONG", "MEDIUM", "SHORT", "VERY_LONG"]
    assert col(spark, texts, T.predict_output_tokens("v")) == [1200, 800, 400, 150, 1200]


def test_extraction(spark):
    assert col(spark, ["2024년 GDP", "x2024 20245 1899"], T.years("v")) == [["2024"], []]
    assert col(spark, ["2024.1 v1.2.3.4 Python 3.12는"], T.versions("v")) == [["2024.1", "v1.2.3", "3.12"]]
    assert col(spark, ["algorithm", "TCP와 UDP의 차이점을 설명해줘", "use https"], T.tech_keywords("v")) == [
        ["go"], ["tcp", "udp"], ["http", "https"]]
    assert col(spark, ["2024 2024 2024", ""], T.extract_keywords("v")) == [["2024"], []]


def test_normalize(spark):
    got = col(spark, ["파이썬 list와 tuple 차이가 뭐야", "linked list 구현해줘", "Stack과 Queue", "checklist lists", "오버피팅"],
              T.normalize("v"))
    assert got == ["파이썬 리스트와 튜플 차이가 뭐야", "연결 리스트 구현해줘", "스택과 큐", "checklist lists", "오버피팅"]


def test_key_equals_canonical_json(spark):
    rng = random.Random(3)
    alphabet = ['"', "\\", "\n", "\t", "\b", "\f", "\x01", "\x0b", "\x1f", "\x7f", "é", "한", "😀", "u000B", "\\u000B", "a", "/", "<"]
    rows = [([(rng.choice(["user", "system"]), "".join(rng.choices(alphabet, k=rng.randint(0, 12))))
              for _ in range(rng.randint(0, 4))],) for _ in range(150)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(keys.l1_key()).collect()]
    want = ["llm:cache:" + hashlib.md5(json.dumps(
        [{"role": r, "content": c} for r, c in m[0]], ensure_ascii=False, sort_keys=True).encode()).hexdigest() for m in rows]
    assert got == want


@pytest.mark.parametrize("q, lang, elang, kws, reason", [
    ("2024년 GDP", "ko", "en", ["2024"], "lang_mismatch"),
    ("2024년 GDP", "ko", "ko", ["2023"], "numeric_mismatch"),
    ("2024년 GDP", "ko", "", ["2024"], "all_checks_passed"),
    ("GDP", "ko", "ko", ["2024"], "all_checks_passed"),
    ("python sorting algorithm", "en", "en", ["java", "sorting"], "tech_keyword_mismatch"),
    ("HTTP와 HTTPS", "ko", "ko", ["http", "https"], "all_checks_passed"),
])
def test_validate(spark, q, lang, elang, kws, reason):
    df = spark.createDataFrame([(q, lang, elang, kws)], "query_text string, lang string, entry_lang string, entry_keywords array<string>")
    r = df.select(V.validate().alias("v")).first().v
    assert (r.passed, r.reason) == (reason == "all_checks_passed", reason)


def test_quota(spark):
    assert col(spark, [700, 800, 950, 1000, 1500, None], quota.quota_status("v", 1000), "bigint") == [
        "OK", "WARNING", "WARNING", "EXCEEDED", "EXCEEDED", "OK"]
    assert col(spark, [300, 1500], quota.quota_remaining("v", 1000), "bigint") == [700, 0]
    d = spark.createDataFrame([("2026-02-22 10:00:00",)], "s string").select(F.to_timestamp("s").alias("ts"))
    assert d.select(quota.quota_month(), F.date_format(quota.month_end(), "yyyy-MM-dd HH:mm:ss")).first()[:] == (
        "202602", "2026-02-28 23:59:59")


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])],
                               "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine_sim("a", "b")).collect()] == [1.0, None, None]


def test_truncation(spark):
    df = spark.createDataFrame([("r", 0, "a" * 1000, 1), ("r", 1, "b", 1), ("s", 0, "", 150), ("s", 1, "ok", 150)],
                               "response_id string, seq int, delta string, predicted_max int")
    got = {(r.response_id, r.seq): (r.delta[-11:], r.truncated) for r in truncate_stream(df).collect()}
    assert got == {("r", 0): ("[TRUNCATED]", True), ("s", 1): ("ok", False)}


def test_moving_average(spark):
    depths = [0] * 12 + [100]
    df = spark.createDataFrame([("p", i, d) for i, d in enumerate(depths)], "pod string, ts int, depth bigint")
    out = trailing_mean(df, "depth", ["pod"], ["ts"], F.floor(F.col("ts") / 4), {"a": 12, "b": 60}).orderBy("ts").collect()
    assert out[-1].a == pytest.approx(100 / 12) and out[-1].b == pytest.approx(100 / 13)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_trailing_mean_over_chunks(spark, kind):
    rng = random.Random(5)
    rows = [(k, i * 3, rng.randint(0, 50)) for k in "ab" for i in range(100)]
    df = spark.createDataFrame(rows, "k string, t int, v bigint").withColumn("v", F.col("v").cast(kind))
    out = trailing_mean(df, "v", ["k"], ["t"], F.floor(F.col("t") / 50), {"m": 7}, chunk=9)
    assert out.count() == len(rows)
    for r in out.collect():
        past = [v for k, t, v in rows if k == r.k and t <= r.t][-7:]
        assert r.m == pytest.approx(sum(past) / len(past))


def test_running_sum(spark):
    rows = [("a" if i % 3 else "b", i, i % 7) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, t int, v int")
    for r in running_sum(df, F.col("v"), ["k"], ["t"], F.floor(F.col("t") / 10), "s", inclusive=False).collect():
        assert r.s == sum(v for k, t, v in rows if k == r.k and t < r.t)


def test_order_statistics(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([0.0, 5.0, 5.0, rng.random() * 1000])) for g in "xyz" for _ in range(rng.randint(1, 200))]
    df = spark.createDataFrame(rows, "g string, v double")
    out = order_statistics(df, "v", ["g"], {"p95": F.floor(F.col("n") * F.lit(0.95)), "lo": F.lit(0)})
    for r in out.collect():
        vals = sorted(v for g, v in rows if g == r.g)
        assert (r.n, r.p95, r.lo) == (len(vals), vals[int(len(vals) * 0.95)], vals[0])


def test_histogram_quantile(spark):
    hist = spark.createDataFrame([("hit", le, 10) for le in ("0.01", "0.05", "+Inf")] + [
        ("miss", "0.01", 0), ("miss", "0.05", 0), ("miss", "+Inf", 4)], "cache_status string, le string, cum bigint")
    got = {r.cache_status: r.p50 for r in histogram_quantile(hist, {"p50": 0.5}).collect()}
    assert got == {"hit": 0.005, "miss": 0.05}


def test_quota_gate_equals_one_at_a_time(spark):
    rng = random.Random(9)
    rows = [(f"{i:03}", rng.choice("uv"), 1704067200 + i * 977, rng.randint(0, 300)) for i in range(150)]
    df = spark.createDataFrame(rows, "request_id string, user_id string, s bigint, tokens int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.request_id: (r.admitted, r.used_before) for r in quota_gate(df, 1000).collect()}
    used = {}
    for rid, u, _, tokens in rows:
        before = used.get(u, 0)
        assert got[rid] == (before < 1000, before)
        used[u] = before + (tokens if before < 1000 else 0)


def test_rules_round_trip(spark, tmp_path):
    own = Rules(term_map={"cat": "고양이"}, keywords={"x": ("abc",)})
    for name, df in rule_frames(spark, own).items():
        df.write.json(f"{tmp_path}/{name}")
    back = load_rules(spark, str(tmp_path))
    assert back.term_map == own.term_map and back.keywords == own.keywords
    assert [(n, p, set(w)) for n, p, w in back.query_classes] == [(n, p, set(w)) for n, p, w in own.query_classes]
    assert set(back.slo) == set(own.slo) and set(back.stages) == set(own.stages)
    assert load_rules(spark, str(tmp_path / "none")) == Rules()
    with pytest.raises(ValueError):
        Rules(term_map={"-x": "y"})
