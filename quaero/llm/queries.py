"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from quaero.llm import decontaminate, html_extract, maxent_lm, mixing, quality_crf, secret_scan, simhash, substring_dedup, token_count, toxicity


def op1_toxicity(spark, sf_dir):
    """Expected toxicity severity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity.score(docs, toxicity.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_maxent_lm(spark, sf_dir):
    """Log probabilities of all documents by a model of those not held out."""
    return maxent_lm.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_simhash(spark, sf_dir):
    """Near-duplicate groups of all documents."""
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_token_count(spark, sf_dir):
    """Tokens of all documents by the 32k piece model."""
    import public_tokenizers

    return token_count.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_quality_crf(spark, sf_dir):
    """Base counts and line-labelling verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_crf.judge(docs, quality_crf.fit_from_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_decontaminate(spark, sf_dir):
    """Shared 13-word spans of all documents and all benchmark items."""
    return decontaminate.decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_mixing(spark, sf_dir):
    """Raked weights and draws of all documents."""
    return mixing.op7(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_substring_dedup(spark, sf_dir):
    """All documents without the 13-word windows of documents before them."""
    return substring_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_html_extract(spark, sf_dir):
    """Main text of all pages."""
    return html_extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_secret_scan(spark, sf_dir):
    """Secrets in all documents, each distinct text scanned once."""
    return secret_scan.report(secret_scan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_maxent_lm": op2_maxent_lm,
    "op3_simhash": op3_simhash,
    "op4_token_count": op4_token_count,
    "op5_quality_crf": op5_quality_crf,
    "op6_decontaminate": op6_decontaminate,
    "op7_mixing": op7_mixing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extract": op9_html_extract,
    "op10_secret_scan": op10_secret_scan,
}

SQL = {
    "op6_decontaminate": decontaminate.SQL,
    "op7_mixing": mixing.sql(),
    "op8_substring_dedup": substring_dedup.SQL,
    "op10_secret_scan": secret_scan.sql(),
}
