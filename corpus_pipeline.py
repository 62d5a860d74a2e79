"""A training corpus from raw documents: five stages, each written as Parquet and read again.

Defined cases, for every stage: a null text counts as an empty one and stays null where the stage
keeps it; equal rows are one document to the near-dedup, which keeps one of them, and to the
others each a row; rows that share a doc_id, or have none, are told apart by their texts; a table
without rows gives none; extra columns go through, whatever their names are. The last stage adds
epoch, block, shard and place, with _ behind a name that the documents have already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, mixing, neardup, pii, quality
from leafmill.llm.common import Folder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: SimHash's, joined by links that its radius misses."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth mentioning."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; n_chars follows the text."""
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's blocks: columns of documents, then epoch, block, shard, place."""
    return mixing.Mix(docs).materialize(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", replace_pii),
    ("mixing sources", mix),
]

#: Trained weights, fingerprints and keyed draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What lies between stages goes to the shared checkpoint folder."""
    folder = Folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = folder.keep(f"{k}", stage(spark, docs, sf_dir))
        folder.only(f"{k}")  # a stage reads its predecessor's rows and no others
    return docs
