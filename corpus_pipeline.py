"""From raw documents to packed sequences: quality rules, line dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one returns is written and read again before the next.  All but
the last return the columns of documents.

Defined results: rows without text fail the quality rules and go; rows without doc_id are kept, stand under a hash of their text, and
come before all others; of repeated rows the near-dedup stage keeps one, that of the smallest doc_id (of equal ids the least hash of the
text); documents that lose every line, byte or word go; texts of any length are taken whole, each in one task at a time; extra columns
of any name come through unchanged up to packing, n_chars counts anew; an empty table gives an empty one at every stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from llm import line_dedup, near_dedup, packing, quality_rules, suffix_dedup
from llm.common import importable, materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that align with an earlier document's go."""
    importable(spark)
    return line_dedup.remove_lines(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash fingerprints in pivot distance tables list pairs, those of 5-word
    Jaccard similarity 0.8 or more are linked."""
    importable(spark)
    return near_dedup.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once go: runs of 51 words, however few bytes they have, and strings of 250 bytes."""
    importable(spark)
    return suffix_dedup.remove_repeats(docs, length=250, words=51)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences: one row per piece."""
    importable(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near), ("suffix-array dedup", passages), ("packing", pack)]
#: Fitted scores, patience alignment and BPE are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
