"""A training-data pipeline of five stages: language ID, n-gram Jaccard join, suffix-array dedup, decontamination, packing.

Every stage takes and (but for the last) returns the columns of documents, with extra ones whatever their names, and works on all rows given.
An empty table gives an empty one at each stage. Null and empty texts, ties, repeated rows and null ids are settled by the stages:

1. language ID: a text that is null, has no letters or fits no known language goes, whatever its id; repeats are judged alike.
2. n-gram join: of linked rows (five words, 80 %) the one of the least id stays, null counting as the largest; rows of one id with unlike texts
   are unlike rows; of rows with equal id and text one stays.
3. suffix dedup: bytes that repeat from a smaller id go (null is the largest; equal ids don't match each other); a row of which nothing but white space is left goes.
4. decontamination: a row that holds a benchmark item goes, with a null id too.
5. packing: every row's ids lie in exactly one piece each; rows with equal or null ids are packed each by itself.

Very long texts are taken whole everywhere. When a stage starts, what the stage before it left in the shared folder is removed, but for files that
its input reads: stages are meant to be written before the next one starts, as `run` does.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cytoloom.llm import base, decontamination, language_id, ngram_join, packing, suffix_dedup
from cytoloom.llm.base import materialise, table

#: Words in a shingle and least similarity (in %) of near duplicates; operator 9 has its own.
NEAR_SHINGLE, NEAR_THRESHOLD = 5, 80

_mark: list[int] = []


def _after(stage: Callable) -> Callable:
    """A stage that first removes the scratch of the one before it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _mark[:] = [base.release(spark, _mark[0], docs) if _mark else base.made()]
        return stage(spark, docs, sf_dir)

    return run


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go."""
    base.small_batches(spark)
    _mark[:] = [base.made()]
    return language_id.accepted(docs)


@_after
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the n-gram Jaccard join, the one with the least id stays."""
    return ngram_join.one_of_each(docs, NEAR_SHINGLE, NEAR_THRESHOLD)


@_after
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that repeat from a document with a smaller id go; texts are what is left."""
    return suffix_dedup.rewrite(docs)


@_after
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@_after
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of 2048-token sequences."""
    return packing.pieces(packing.encode(docs))


STAGES = [("language_id", languages), ("ngram_jaccard_join", near_duplicates), ("suffix_array_dedup", repeated_passages), ("benchmark_decontamination", decontaminate), ("packing", pack)]
#: The language models, the latent space and the tokenizer can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
