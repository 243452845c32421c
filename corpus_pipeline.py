"""A corpus pipeline of training-data operators: language, toxicity, near-duplicates, mixing, packing.

Each stage reads what the one before kept (written as Parquet); all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmask.llm.common import only_last, read, written
from tagmask.llm.language_id import UNKNOWN, identify, train_languages
from tagmask.llm.mixing import take_mix
from tagmask.llm.near_dup import drop_near_duplicates
from tagmask.llm.packing import pack_documents
from tagmask.llm.toxicity import fit_toxicity

#: Share of a text's n-grams that its language must know.
LEAST_KNOWN = 0.15


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: those without letters, and those of which hardly an n-gram is known, go."""
    judged = identify(docs, train_languages(docs))
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_known") >= LEAST_KNOWN)).select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return fit_toxicity(docs, read(spark, sf_dir, "labels")).score(docs).filter("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 4096 ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: Trained models, signatures and tokenizers have no SQL; tests/llm/test_pipeline.py states the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    with only_last(spark):
        for name, stage in STAGES:
            with only_last(spark):
                docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
