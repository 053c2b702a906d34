"""The registered queries of the training-data operators and their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import crf_toxicity, hd_langid, html_wrapper, jaccard_join, line_rules, lz_dedup, nbsvm, oracles, piece_codec, prefix_trie, secret_scan, syncmers, whitening, winnowing
from runlens.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def _fold(modulus: int, held: int) -> F.Column:
    """True on the rows whose label may not be learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(True))


def _labels(spark: SparkSession, sf_dir: str, column: str, modulus: int, held: int) -> DataFrame:
    """The labels that may be learned from, as (doc_id, label)."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_fold(modulus, held)).select("doc_id", F.col(column).alias("label"))


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(documents(spark, sf_dir))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup.dedup(documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode_documents(documents(spark, sf_dir), piece_codec.load_vocabulary(spark))
    return coded.select("doc_id", "ids", "n_tokens", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", _fold(3, 1))
    return nbsvm.score(docs, nbsvm.fit(docs.filter("NOT held_out"), _labels(spark, sf_dir, "quality", 3, 1)))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", _fold(4, 2))
    return hd_langid.predict(docs, hd_langid.prototypes(docs.filter("NOT held_out")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", _fold(5, 0))
    return crf_toxicity.score(docs, crf_toxicity.fit(docs.filter("NOT held_out"), _labels(spark, sf_dir, "toxic", 5, 0)))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return winnowing.decontaminate(documents(spark, sf_dir), items).drop("hit_spans")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("conv_id") - F.col("conv_id") % 5
    head = F.crc32(F.col("conv_id").cast("string")) % 9
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), base, head, max_head=8)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_syncmer_fingerprints": op1_syncmer_fingerprints,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scans": op10_secret_scans,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_rules": op13_quality_rules,
}
ORACLE: dict[str, str] = {
    "op2_ngram_jaccard_join": oracles.JACCARD,
    "op3_substring_dedup": oracles.DEDUP,
    "op9_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_conversation_trie": oracles.TRIE,
    "op13_quality_rules": oracles.LINE_RULES,
}
