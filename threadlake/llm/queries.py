"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.llm import fingerprints, html_extraction, media, merkle, mixing, ngram_join, packing, repeats, token_counts, toxicity, txlog, url_templates, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.fit_model(docs, _table(spark, sf_dir, "labels")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.filter_urls(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_table(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op13_txlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.replay(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_ngram_join, op2_media, op3_packing, op4_html_extraction, op5_mixing, op6_toxicity, op7_fingerprints, op8_repeats, op9_url_templates, op10_token_counts, op11_merkle, op12_warc, op13_txlog)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.oracle("documents"),
        "op8_repeats": repeats.oracle("documents"),
        "op9_url_templates": url_templates.oracle("pages"),
        "op11_merkle": merkle.oracle("documents"),
        "op12_warc": warc.oracle("pages"),
        "op13_txlog": txlog.oracle("documents", "labels"),
    }
