"""A training-data pipeline over ``documents``: toxicity, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.pipeline_stages import drop_near_copies, drop_toxic, mix, pack_documents
from quillspark.llm.queries import MIX_EPOCHS, MIX_SHARE, MIX_WEIGHTS, domain_of_source, table, tokenizer_path
from quillspark.workspace import Scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under a toxicity of 0.5."""
    return drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(spark, docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources, documents repeated as often as it takes them."""
    return mix(spark, docs, MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, domain_of_source())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents as sequences of a power of two of tokens."""
    return pack_documents(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Scoring, similar sets and tokenizing have no SQL: tests hold every stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents, each result written and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
