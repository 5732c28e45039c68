"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir).  All but the last return the columns of
``documents``; n_chars follows the text.  In every stage an empty table stays empty,
other columns pass through whatever their names, and very long texts are read whole.
Rows without doc_id stay but for the language stage's verdict on their text, as they
can't be told apart; rows that share a doc_id are one document and stay or go
together, but in the language stage, which judges each row's text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import language_id, line_templates, minmax_dedup, piece_codec, spaced_seeds
from skerry.llm.workspace import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language has a posterior under one half, go.

    Learnt from the rows with a lang; where none has one, only those without a letter go.
    """
    return language_id.keep_identified(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the first document's; so do documents of which only blanks are left.

    Null, empty and blank texts stay as they are.
    """
    counted = next(f"n_dropped{i or ''}" for i in range(len(docs.columns) + 1) if f"n_dropped{i or ''}" not in docs.columns)
    cut = line_templates.drop_recurring_lines(docs, counted=counted)
    cut = cut.where((F.col(counted) == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]")).drop(counted)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the smallest doc_id stays; null, empty and blank texts stay."""
    return minmax_dedup.drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's words go; items of under four words take only documents that are nothing else."""
    return spaced_seeds.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document left, checked to decode to its text; a null text has none."""
    return piece_codec.encode_documents(docs)


STAGES = [
    ("language", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("encoding", encode),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ws = Workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir))
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
