"""Corpus pipeline (part of the training-data subpackage): stages over ``documents``, each written and read again.

Quality rules, site-relative line dedup, near-duplicate documents, repeated passages, packing. All but the last stage
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlake.llm import line_dedup, ngram_join, packing, quality_rules, suffix_dedup
from paperlake.llm._spark import cut

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the cascade of quality rules rejects go."""
    return quality_rules.keep(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of a source's different texts go, so copies count once; a null text stays null."""
    lines = F.split("text", "\n", -1)
    into = "_kept" + "_" * max(map(len, docs.columns))  # longer than any column's name
    kept = line_dedup.dedup(docs, "source", F.coalesce(lines, F.array().cast("array<string>")), into=into, copies_once=True)
    text = F.when(F.col("text").isNull(), None).otherwise(F.concat_ws("\n", into))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: words in fives, similarity 0.8 or more."""
    return ngram_join.keep_first(docs, size=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of passages of 200 bytes or more that stand elsewhere too go."""
    return suffix_dedup.remove(docs, 200)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 tokens."""
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("best-fit packing", packing_stage),
]

#: Repeats of bytes and packing have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
