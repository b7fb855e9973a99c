"""Corpus preparation in stages over documents; belongs to newsloom.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with their columns as they are, whatever these are
named; the last returns pieces of packed sequences. Labels and benchmark items are read from sf_dir.

In every stage an empty table stays empty, repeated rows are judged one by one (but see near_duplicates), long texts are read whole, and columns that are
named like an operator's own results are neither read nor changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import decontaminate, importance, langid, ngramjoin, packing
from newsloom.llm.common import stored

#: Posterior probability that a document's language needs
LEAST_CERTAIN = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What importance resampling chooses: as large a share of the documents as the labelled ones of quality 1 are. Null and empty texts have the
    weight 0 and mostly stay; documents without an id share their noise; equal keys at the bound all stay."""
    return importance.select(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, known with some certainty. Null texts and texts without a letter go; null languages
    don't teach; without any known language no document stays."""
    return langid.certain(docs, public_tokenizers.path("piece_bpe_32k.model"), LEAST_CERTAIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents, that of the least id; of several rows of an id the one with the least text. Rows without an
    id stay; null and wordless texts are linked with nothing and stay."""
    return ngramjoin.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and wordless texts hold none; null items have no windows."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences. Null and empty texts are their end id; a null id stays null; other columns aren't carried."""
    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

# Tokenizers, trained models and Gumbel noise are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, f"after-{name}")
    return docs
