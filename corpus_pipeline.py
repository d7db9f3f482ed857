"""Corpus pipeline: from raw documents to packed training sequences.

Stages, in order: quality rules reject documents; later copies of repeated line runs (three lines, or 50 words) are cut,
and documents of which nothing is left go; one document of each near-duplicate group stays; personal data get surrogates; what remains is
tokenized and packed. All but the last return the columns of ``documents`` (n_chars follows the text).

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and may be run alone on a table in the
shape of ``documents``. Nulls, empty tables and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.llm import line_dedup, ngram_join, packing, pii, quality_rules
from regista.llm.common import read, shared_dir

#: Secret of the surrogates; a deployment sets its own.
PII_KEY = b"regista surrogates"
#: Repeated runs of fewer than three lines go too if they hold this many words.
LONG_PASSAGE = 50


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with n_chars counted anew."""
    return docs.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the isolation forest doesn't find anomalous."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which only white space is left go."""
    cut = line_dedup.strip_runs(docs, min_words=LONG_PASSAGE)
    return _counted(cut.where((F.col("n_removed") == 0) | F.col("text").rlike(line_dedup.NON_BLANK)), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _counted(pii.pseudonymise(docs, PII_KEY), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("PII surrogates", personal_data), ("best-fit packing", packed)]
#: The forest, MinHash, keyed surrogates and tokens aren't SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; every stage's result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/stage-{k}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
