"""The corpus pipeline: rate, remove near duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a table; run() writes it as Parquet in the cluster's shared folder
and the next stage reads it again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm.common import fresh_folder, table
from lexispark.llm.mixing import mix_sources
from lexispark.llm.near_dedup import keep_one
from lexispark.llm.packing import pack
from lexispark.llm.quality import grade_documents
from lexispark.llm.queries import MIX_REPETITION, tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model holds to be good: a probability of 0.4 or more of the best grade.

    Null and empty texts are judged by their shape alone, repeated rows each; no rows give no rows. All columns stay.
    """
    return grade_documents(docs, table(spark, sf_dir, "labels")).where("keep").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents linked by a similarity of 0.8 or more; those without words stay.

    Of repeated rows one stays; null ids give way to others. No rows give no rows. All columns stay.
    """
    return keep_one(docs, percent=80)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of smaller sources again until their weights are met, at most twice.

    A null source is one of its own; texts without tokens, null ones among them, stay once. All columns stay.
    """
    return mix_sources(docs, repetition=MIX_REPETITION).rows.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths; a null or empty text is its end token alone."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("mixing_sources", mixing_sources),
    ("packing", packing),
]

#: Hashed features, banding and tokenizing are beyond SQL; tests/llm/test_pipeline.py holds each stage against a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents table."""
    at = fresh_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
