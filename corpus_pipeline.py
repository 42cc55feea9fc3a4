"""From raw documents to packed training sequences: quality rules, toxicity, near-duplicates, packing.

Each stage reads what the stage before has written and returns a DataFrame; all but the last keep whole rows of
``documents`` with the same columns, whatever further columns there are and whatever their names. Empty tables give empty
results with the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxelry.llm import packing, quality, simhash, toxicity
from voxelry.llm.shared import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break the base rules or are outliers of their language and source go.

    Null and empty texts have no words and go; a null language or source is a value of its own; repeated rows stay or go
    together.
    """
    return quality.drop_low_quality(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the chain is fitted on the labelled ones among ``docs``.

    Null and empty texts are never toxic; a null id has no label but is scored; repeated rows stay or go together; without
    labels of both classes no document goes unless all labelled ones are toxic.
    """
    return toxicity.drop_toxic(docs, toxicity.read_labels(spark, sf_dir))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest id.

    Texts without words, null ones among them, are a class; of repeated rows one stays; a null id comes after all others.
    """
    return simhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences. A null text is empty and has one piece, the final token."""
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, added=True)


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier and the packing plan are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table of documents; each result is written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{at}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
