"""A corpus pipeline of four stages: quality classifier, host-level quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again as the next one's documents. All but the last return the columns of documents.

The near-duplicate stage compares what SimHash pigeonring filtering (operator 7) links, and what bands of minimum hashes
bring together beyond that, by the exact similarity of five-word shingles: fingerprints alone miss most pairs of 0.8.

Cases: as in the operators' own statements. Documents without words fall to the quality rules; rows without an id stay
apart from the near-duplicates; equal rows are one document to that stage. No documents give no pieces.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

from tagflow.llm import knn_quality, near_texts, quality_rules
from tagflow.llm.queries import documents, packed
from tagflow.sources import table
from tagflow.storage import fresh, remove


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt on these documents' labels, takes for good."""
    model = knn_quality.train(docs, table(spark, sf_dir, "labels"))
    return knn_quality.accepted(docs, model)


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor their host's verdict reject."""
    return quality_rules.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of texts whose five-word shingles are similar by 0.8 or more."""
    return near_texts.deduplicated(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packed(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("host_rules", host_rules),
    ("near_duplicates", near_duplicates),
    ("sequence_packing", sequence_packing),
]

#: SQL can't express the classifier or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage leaves is removed as soon as the next one's rows are written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = fresh(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
