"""A corpus-preparation pipeline: each stage reads what the one before it wrote, and acts on all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import stages

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.toxicity_filter),
    ("line_dedup", stages.line_dedup),
    ("near_dedup", stages.near_dedup),
    ("decontamination", stages.decontaminate),
    ("packing", stages.packing),
]

#: No stage can be written in SQL as a whole (learned scores, fingerprints, packing); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result but the last is written to the shared folder and read again."""
    from pointloom.llm.common import staged

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
