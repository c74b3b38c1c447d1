"""What the simhash index broadcasts: never rows that were exploded, nor a row a document."""

import random

import corpus_pipeline
import pytest

from promptlake.llm import simhash_index


def broadcast_parts(df):
    """The subtree below each broadcast of the plan, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i:end])


def near_rows(n=300):
    """Fingerprints in pairs one bit apart, so that many lists have two entries."""
    rng = random.Random(3)
    values = [rng.getrandbits(63) for _ in range(n)]
    return [(x,) for v in values for x in (v, v ^ 1)]


@pytest.mark.parametrize("few", [1 << 17, 0])
def test_links_broadcast_nothing_exploded(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(simhash_index, "FEW_LISTS", few, raising=False)
    spark.createDataFrame(near_rows(), "fp long").write.parquet(f"{tmp_path}/fps")  # a few kilobytes, and 70 times the rows
    found = simhash_index.links(spark.read.parquet(f"{tmp_path}/fps"))
    below = list(broadcast_parts(found))
    assert not [x for x in below if "Generate" in x or "Aggregate" in x]
    assert bool(below) == bool(few)
    assert {(max(r), min(r)) for r in found.collect()} == {(max(a, a ^ 1), min(a, a ^ 1)) for a, in near_rows()}


def test_no_row_a_document_is_broadcast(spark):
    texts = [(i, " ".join(random.Random(i // 2).choices("abcdefgh", k=40))) for i in range(100)]
    found = simhash_index.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert not list(broadcast_parts(found))
    assert {(r["doc_id"], r["component_id"]) for r in found.collect()} == {(i, i - i % 2) for i in range(100)}


def test_pipeline_stage_broadcasts_only_ids_kept(spark, monkeypatch):
    """The stage of the pipeline, where all crowded lists meet by a sort-merge join."""
    monkeypatch.setattr(simhash_index, "FEW_LISTS", 0, raising=False)
    texts = [(i, " ".join(random.Random(i // 2).choices("abcdefgh", k=40)), "en", "web", 79) for i in range(60)]
    rows = [*texts, texts[2], (None, texts[4][1], "en", "web", 79)]  # an id that repeats, no id
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert len(list(broadcast_parts(kept))) <= 1  # of a few rows, by their number times that of others; of many, as measured
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [*range(0, 60, 2), None]
