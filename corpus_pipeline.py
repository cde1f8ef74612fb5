"""A corpus from raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of ``documents``:

1. language: documents that the language identifier rejects go;
2. exact: of documents with equal texts one stays;
3. near: of documents that n-gram links join one stays (the smallest doc_id);
4. mix: documents are repeated or left out so that sources reach their targets;
5. pack: texts are tokenized and packed into sequences of 1024 tokens.

Null texts go in the first stage (no language); a table without rows, or of
which a stage keeps nothing, gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assay.llm import exact_dedup, language_id, mixing, ngram_join, packing
from assay.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from a bounded sample of ``docs``; null texts, texts without letters and rejected ones go.

    Repeated rows share one fate; very long texts are read whole; without a language to learn, all texts with letters stay."""
    return language_id.accepted(docs, language_id.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest doc_id (null first, ties by text); null and empty texts are one group."""
    return exact_dedup.without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked texts, the one with the smallest doc_id that is not null; texts without words all stay.

    Repeated doc_ids are separate rows, so near copies under one doc_id go too."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as at least half of it is taken by the mix, so none, once or up to three times; a null source is a source, the last one.

    Documents without words are never taken; rows of one doc_id come as often as the one that is taken most."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document (null and empty texts: the end token alone); longer texts than a sequence are cut, repeated rows are packed each."""
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Learned models and tokenizers are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
