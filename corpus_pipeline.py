"""Corpus pipeline over documents: quality rules, near-duplicates, repeated passages, source mixing, packing.

Every stage takes all that its predecessor kept, as Parquet in the shared folder, and all but the last return the columns of
documents.

Nulls: a null text is empty and goes with the quality rules; a null doc_id stays (near-duplicates and repeated passages are looked for
among documents with an id); a null source is a source of its own in the mix. Repeated rows are near-duplicates of each other, so one
stays. Very long texts are read whole in every stage. An empty table gives no rows. Extra columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareflow.llm import mixing, packing, quality_rules, simhash, substring_dedup
from wareflow.llm.common import materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules keeps."""
    return quality_rules.reject(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (five-word shingles)."""
    return simhash.deduplicate(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that a document with a smaller id has too."""
    return substring_dedup.without_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of all sources, a row for each copy, in training order."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in its sequence."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizing is beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
