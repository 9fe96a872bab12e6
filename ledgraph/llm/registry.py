"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, line_dedup, lm_score, minhash, pieces, quality, secrets, suffix_dedup, url_filter
from .common import table
from .oracles import ORACLES


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.scan(table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that share a passage of 50 words or more with another one."""
    return suffix_dedup.summary(suffix_dedup.repeats(table(spark, sf_dir, "documents")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text as a digest, and whether decoding them gives the text again."""
    encoded = pieces.encode(table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_pieces", "n_bytes", F.sha2(F.array_join("pieces", " ").cast("binary"), 256).alias("pieces_sha256"), "exact")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_suffix_dedup,
        op3_quality,
        op4_url_filter,
        op5_line_dedup,
        op6_lm_score,
        op7_html_text,
        op8_near_duplicates,
        op9_sentencepiece,
        op10_decontamination,
    )
}
__all__ = ["ORACLES", "QUERIES"]
