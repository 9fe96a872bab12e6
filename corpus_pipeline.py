"""A corpus pipeline over five of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``.  ``run`` writes each stage to the shared
folder and reads it again, so a lost executor costs no earlier stage.

1. quality: documents that fail a rule go.
2. line_dedup: repeated runs of two lines or more go from the texts; every document stays.
3. near_dedup: of each group of near-duplicates (five words, 0.8) the one with
   the smallest id stays; documents without words are in no group and stay.
4. decontamination: documents that hold a benchmark window go.
5. sentencepiece: pieces of each text, and whether decoding gives it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgraph.llm import decontamination, line_dedup, minhash, pieces, quality
from ledgraph.llm.common import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_runs(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

# Near-duplicate groups and the segmentation are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
