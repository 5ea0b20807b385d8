"""A corpus pipeline: quality rules, near duplicates, repeated passages, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; run() writes
each stage's result to the shared folder and reads it back as the next one's input. What a stage wrote on the way is
deleted when its result stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hazeline.llm.common import n_folders, remove_folders, shared_dir, table
from hazeline.llm.jaccard import distinct_documents
from hazeline.llm.mixing import mixed_documents
from hazeline.llm.pieces import encoded_documents
from hazeline.llm.quality import kept_documents
from hazeline.llm.substrings import deduplicated_documents

STAGES = [
    ("quality_rules", kept_documents),
    ("jaccard_join", distinct_documents),
    ("substring_dedup", deduplicated_documents),
    ("mix_sources", mixed_documents),
    ("sentencepiece", encoded_documents),
]

#: The gear hash, the chosen paths and the encoding have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path, before = shared_dir(spark, f"pipeline-{name}"), n_folders()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        remove_folders(spark, before)
    return docs
