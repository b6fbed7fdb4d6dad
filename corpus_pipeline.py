"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the folder
that all executors share and reads it again for the next stage.

Defined results: rows without text, or of no clear language, go in the first stage; very long texts are read whole by
every stage; of equal or near texts one row stays, rows being told apart by their place, so that shared or null ids
lose no text; null languages and sources have leaves of their own in the mix, which takes or leaves rows of one id
together; extra columns of whatever name are carried as they are up to the last stage, which ignores them; an empty
table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import dedup, langid, mixing, ngram_join, packing
from millrace.llm.common import documents, materialise
from millrace.plans.session import ship

#: The mix keeps nearly all tokens in sum: parts in short supply are used twice, the largest source gives way.
MIX_SHARE = 0.9
#: Near copies share this part of their 5-word n-grams or more (op5, the query by itself, has a contract of 4 words and 85).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without a clear one, go."""
    ship(spark)
    return langid.accept(docs, langid.train(langid.training_rows(docs)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    ship(spark)
    return dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts one stays."""
    ship(spark)
    return ngram_join.keep_one(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's budget uses them."""
    ship(spark)
    return mixing.mix(docs, mixing.WEIGHTS, MIX_SHARE, added=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing and language models are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
