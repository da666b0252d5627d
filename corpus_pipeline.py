"""A training corpus from raw documents, in five stages.

toxicity -> exact deduplication -> near-duplicate join -> credentials masked -> packing.

Each stage works on all that its predecessor kept and is written as Parquet before the next one
reads it.  All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesmill.llm import credentials, exact, jaccard, packing, toxicity
from seriesmill.llm.common import stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half for toxicity stay; the network learns from the labels."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.keep_one(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies (five-word n-grams, Jaccard index 0.8) the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def without_credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked in the text; every document stays."""
    return credentials.mask_live(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens in the proportions of the sources, one row per piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", clean), ("exact_dedup", distinct_texts), ("ngram_jaccard_join", distinct_content),
    ("secret_scan", without_credentials), ("packing", packed),
]

# Models and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
