"""The training-data pipeline: language, exact and near duplicates, mix, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns what the next
one reads as its documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ticklake.llm import exact_dedup, langid, mixing, ngram_join, packing
from ticklake.llm.common import table
from ticklake.llm.queries import BYTE_TOKENIZER, tokenizer
from ticklake.session import configure, scratch

#: Words of an n-gram and percent of Jaccard similarity from which two documents are near copies.
NEAR_WORDS, NEAR_SIMILARITY = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters or between two languages go."""
    configure(spark)
    return langid.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    configure(spark)
    return exact_dedup.unique(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of documents linked by five-word n-grams; op1's contract has its own numbers."""
    configure(spark)
    return ngram_join.representatives(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    configure(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    configure(spark)
    return packing.pack(docs, tokenizer(BYTE_TOKENIZER), keeps_space=True, end_id=2)


STAGES = [
    ("language", language),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pack", pack),
]

#: The first stage learns its model from the data, which SQL cannot say; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def load():
    """(queries, sql) of this module."""
    return {"pipeline": run}, {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
