"""The operators as queries over the given tables, each with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from promptlake.llm import (
    filter_audit, hilbert_ann, html_wrapper, langid_crf, lm_score, mixing, odd_sketch, quality_repeats, secrets, sentencepiece_fst, simhash_index,
    source_divergence, toxicity_ftrl)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The public piece model that the box offers."""
    import public_tokenizers

    return sentencepiece_fst.load_model(public_tokenizers.path("piece_bpe_32k.model"))


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_fst.encode_checked(docs, piece_model()).select("doc_id", "n_tokens", "round_trip", "ids")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(load(spark, sf_dir, "pages"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    target = lm_score.labelled_target(load(spark, sf_dir, "labels"))
    return lm_score.difference(docs, target).drop("text")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    base = F.filter(spans, lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(spans).alias("spans"), count(3).alias("n_markov"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_repeats.repetition(docs).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity_ftrl.train(docs, load(spark, sf_dir, "labels"), fold(5) != 0)
    return toxicity_ftrl.score(docs, weights).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_index.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid_crf.train(docs, fold(4) != 2)
    return langid_crf.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(load(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(load(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_html, op3_lm_score, op4_ann, op5_secrets, op6_quality, op7_toxicity, op8_simhash, op9_mixing, op10_langid,
    op11_filter_audit, op12_source_divergence, op13_minhash)}
ORACLES: dict[str, str] = {
    "op11_filter_audit": filter_audit.SQL, "op12_source_divergence": source_divergence.SQL, "op13_minhash": odd_sketch.SQL}
