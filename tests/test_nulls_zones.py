"""Null keys, negative values, zones and failed probes: rows that must not vanish or move."""

from pyspark.sql import functions as F

from promptlake.operators.queue import queue_depth
from promptlake.functions.quota import month_end, quota_month
from promptlake.operators.experiment import by_category, score_pairs, threshold_sweep
from promptlake.operators.ordered import percentiles, running_sum


def test_months_are_utc_in_any_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        row = spark.range(1).select(F.timestamp_seconds(F.lit(1706731200)).alias("ts")).select(  # 2024-01-31T20:00Z
            quota_month().alias("m"), F.unix_seconds(month_end()).alias("e")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (row["m"], row["e"]) == ("202401", 1706745599)


def test_null_keys_and_negative_values_stay(spark):
    df = spark.createDataFrame([("a", 1, -5.0), (None, 2, -7.0), (None, 3, 4.0)], "k string, at long, v double")
    out = running_sum(df, F.col("v"), ["k"], ["at"], F.col("at"), "s").collect()
    assert {(r["k"], r["at"]): r["s"] for r in out} == {("a", 1): -5.0, (None, 2): -7.0, (None, 3): -3.0}
    p = percentiles(df, "v", ["k"], {"p": 0.5}).collect()
    assert {r["k"]: (r["n"], r["p"]) for r in p} == {"a": (1, -5.0), None: (2, -1.5)}


def test_probes_without_candidate_and_failed_probes(spark):
    pairs = spark.createDataFrame([("1", True, "c", None), ("2", True, "c", None), ("3", False, "c", "timeout")], "qid string, expected_hit boolean, category string, error string")
    best = spark.createDataFrame([("1", 0.9, True), ("3", 0.9, True)], "qid string, best_sim double, hit boolean")
    scored = score_pairs(pairs, best, "qid")
    assert {r["qid"]: r["hit"] for r in scored.collect()} == {"1": True, "2": False, "3": True}
    sweep = threshold_sweep(scored, [0.5]).first()
    assert (sweep["total_pairs"], sweep["true_positives"], sweep["false_positives"], sweep["false_negatives"]) == (2, 1, 0, 1)
    assert by_category(scored).first()["pairs"] == 2


def test_depth_is_held_at_zero(spark):
    rows = [("p", None, 50.5), ("p", 50.2, 51.0), ("p", None, 52.0), ("p", 110.0, 4000.0), (None, 1.0, 7.0)]
    df = spark.createDataFrame(rows, "pod string, a double, b double").select(
        "pod", F.timestamp_micros((F.col("a") * 1e6).cast("bigint")).alias("enter_ts"),
        F.timestamp_micros((F.col("b") * 1e6).cast("bigint")).alias("exit_ts"))
    got = {(r.pod, r.s): r.depth for r in queue_depth(df).withColumn("s", F.unix_timestamp("ts")).collect()}
    assert got == {**{("p", s): int(110 <= s < 4000) for s in range(55, 4001, 5)}, (None, 5): 1, (None, 10): 0}


def test_grams_are_counted_before_they_become_rows(spark):
    """A text gives a row for each different gram, however often it repeats it."""
    from collections import Counter

    from promptlake.operators.language import _grams

    texts = ["ab" * 3000, "a\U0001F600b\n\x00a", "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for n_max in (3, 5):
        got = {(r.doc_id, r.gram): r.c for r in _grams(df, "text", "doc_id", n_max).collect()}
        want = Counter((i, t[j:j + n]) for i, t in enumerate(texts) if t for n in range(1, n_max + 1) for j in range(len(t) - n + 1))
        assert got == dict(want)
