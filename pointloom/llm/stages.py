"""The stages of corpus_pipeline.py. Rows keep the columns and types they came with; extra columns pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.queries import WORD_TOKENIZER, vocabulary


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id, and of several with that id the one whose text
    hashes least. Five-word shingles, 0.8.

    Null ids come after all others. Rows equal in id and text are one document: all of them stay or go. Rows of one id with other
    texts are documents of their own. Null and empty texts and those without words stay."""
    from pointloom.llm.common import as_bytes
    from pointloom.llm.neardup import groups

    found = groups(docs, width=5, percent=80)
    apart = ~(F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("th") == F.col("winner.th")))
    gone = found.where(apart).select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(as_bytes(docs["text"])) == gone["gone_th"])
    return docs.join(gone, same, "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, one row per piece. Null and empty texts are the end mark alone; repeated rows and null ids
    are packed like others."""
    from pointloom.llm.packing import pack

    return pack(docs, vocabulary(WORD_TOKENIZER), capacity=2048)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of sf_dir and the texts of docs.

    Each row is judged by its own text, whatever its id; null and empty texts have no terms and stay, as all rows do where labels of
    one kind are missing."""
    from pointloom.llm.toxicity import fit, without_toxic

    return without_toxic(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines are taken out of texts; n_chars follows the text. Rows stay, those with null, empty and emptied
    texts too; rows equal in id and text keep or lose the same lines."""
    from pointloom.llm.linededup import dedup_lines

    return dedup_lines(docs, report=False, n_chars="n_chars" if "n_chars" in docs.columns else None)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go, and those that are one with some words cut.

    Each row is judged by its own text, whatever its id; null and empty texts stay; without items all rows stay."""
    from pointloom.llm.decontaminate import without_leaks

    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
