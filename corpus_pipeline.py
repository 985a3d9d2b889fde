"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and is written before the next one reads it. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versewright.llm import bpe, decontaminate, langid, lines, simhash
from versewright.session import written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on their own labels, accepts; ``lang`` stays as it was.

    Null texts and those without a letter go; a null ``lang`` or ``doc_id`` is kept as any other. Repeated rows share a fate,
    an empty table gives an empty one.
    """
    model = langid.fitted(docs, F.lit(True))
    rows = docs.withColumn("__given_text", F.col("text"))
    kept = langid.identified(rows, model, (*[c for c in docs.columns if c != "text"], "__given_text")).where("accepted")
    return kept.withColumnRenamed("__given_text", "text").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that an earlier one holds aligned; ``n_chars`` follows the text.

    Null and empty texts stay; a text that loses all its lines is empty. Rows without an id come last.
    """
    return lines.deduplicated(docs).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, then the smallest digest of a text.

    Null and empty texts are one group; of repeated rows one stays.
    """
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole benchmark item. Null and empty texts hold none; without items all stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with the digest of what they decode to; a null text is an empty one. Every row stays."""
    return bpe.tokenized(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ("doc_id", "lang", "source"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: Fingerprints, alignment, trained models and BPE aren't SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
