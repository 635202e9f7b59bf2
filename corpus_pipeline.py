"""The corpus pipeline: five stages, each over all documents that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import decontamination, linededup, mixing, ngramjoin, scratch, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts score as harmless and stay, equal texts share a
    score, texts of any length are read whole; without labels of both kinds
    all stay; an empty table gives no rows.
    """
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where(F.col("score") < toxicity.TOXIC).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines one stays in the corpus; the documents stay, with what is left of their text.

    Null, empty, repeated and very long texts are treated as
    ``linededup.dedup`` says; no row goes.
    """
    return linededup.dedup(docs).select(*docs.columns)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one stays; those without words, and those without a group, stay.

    Null, empty and repeated rows, and rows without an id, are treated as
    ``ngramjoin.representatives`` says; an empty table gives no rows.
    """
    return ngramjoin.representatives(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text holds a benchmark item go; others of the same doc_id, or without one, stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, copies numbered from 1.

    A null or empty text has no words, and a null source is one of its own;
    repeated rows are mixed one by one; an empty table gives no rows.
    """
    mixed = mixing.emit(mixing.mix(docs))
    return mixed.select("doc_id", "copy", "text", "source", "size", "source_size", "target")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.table(docs, f"stage{k}")
    return docs
