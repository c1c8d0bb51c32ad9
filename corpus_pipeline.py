"""From raw documents to packed training windows, stage by stage.

Every stage takes (spark, documents, folder of the tables) and returns a DataFrame; all but the last return the
columns of documents. A stage works on what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratusqc.llm import exact_dedup, ngram_join, packing, pii, quality_classifier
from stratusqc.llm.queries import LOWER_TOKENIZER, PII_KEY
from stratusqc.session import write_and_reread


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling leaves out go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.select(docs, labels).keep(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.drop_copies(docs, exact_dedup.halves(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same format."""
    return pii.hide(docs, PII_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in windows of 2048."""
    return packing.pack_documents(docs, LOWER_TOKENIZER)


STAGES = [
    ("quality classifier", select_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", hide_personal_data),
    ("packing", pack),
]

#: The models, the keyed pseudonyms and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_and_reread(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
