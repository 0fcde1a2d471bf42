"""Corpus preparation: five stages over ``documents``, each written as Parquet
and read back as the next one's input. All but the last return the columns of
``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm.common import Leftovers, Scratch, settled, written
from strata.llm.exact_dedup import drop_exact_copies
from strata.llm.mixing import mix
from strata.llm.near_dedup import drop_near_copies
from strata.llm.packing import pack
from strata.llm.quality_rules import keep_good
from strata.sources.files import load_table

TOKENIZER = "word_bpe_49k.json"


# what stages have left on disk; it goes when a later stage starts on rows that are read from elsewhere
LEFT = Leftovers()


def _stage(spark: SparkSession, docs: DataFrame, make: Callable[[], DataFrame], name: str | None = None) -> DataFrame:
    """The result of a stage; with a ``name`` it is written once, so that the
    stage's own tables and shuffle files are gone when the next one begins."""
    LEFT.drop_unread(docs)
    mark = written()
    out = settled(spark, make, name) if name else make()
    LEFT.take(mark)
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    return _stage(spark, docs, lambda: keep_good(docs), "kept-good")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _stage(spark, docs, lambda: drop_exact_copies(docs), "kept-exact")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return _stage(spark, docs, lambda: drop_near_copies(docs), "kept-near")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in serving order."""
    return _stage(spark, docs, lambda: mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in the sequences."""
    return _stage(spark, docs, lambda: pack(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Perplexity bands, consistent sampling and tokenizers have no SQL:
# tests/llm/test_pipeline.py checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = load_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            scratch.drop(before)
        before = f"pipeline-{name}"
    return docs
