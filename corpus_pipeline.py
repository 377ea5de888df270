"""Corpus pipeline: five filtering and encoding stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs; what a stage has read is then
deleted.

Rows without text, or without letters, go with the first stage.  A row without a
doc_id counts as the smallest id to the lines, and is linked by its text alone to
near duplicates: it stays where no document of its component has an id.  Rows
that share a doc_id are one document to both.  Repeated rows stay or go together.
An empty table gives no rows; other columns of any name are kept by all stages
but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taketriage.llm import bpe, decontam, langid, linededup, neardup
from taketriage.llm.shared import discard, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows; documents in no learned language go."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return langid.in_known_language(docs, langid.fit(labelled))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in the last document that has them."""
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its bytes."""
    return bpe.encoded(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near duplicates, the language model and the token ids are beyond SQL.
ORACLE_SQL = None
