"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and is the next one's
docs. All but the last return the columns of documents. Decisions: the quality stage drops what its rules
reject; the near-duplicate stage keeps the document of smallest doc_id of each group (exact Jaccard similarity 0.8 or more
of 5-word shingles, or a chain of such pairs); the substring stage cuts every word that a repeated window of 35 words
covers and counts n_chars anew; the decontamination stage drops documents that hold a benchmark window; the last
stage encodes and decodes the texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontam, fmindex, quality, simhash
from driftlens.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = fmindex.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = bpe.encoded(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return x.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", "ids", "decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: SQL cannot express the BPE stage nor, on whole tables, the similarity join: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
