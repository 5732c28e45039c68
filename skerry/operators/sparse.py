"""Keyword search: postings, statistics and BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import tokens
from skerry.sources.tables import written

K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf, dl) of ``docs(id, document)``; null and empty documents are not indexed."""
    own = docs.where("document is not null and document <> ''").select("id", tokens(F.col("document")).alias("t"))
    return own.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("term", "id", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n and avgdl; documents without a token count."""
    own = docs.where("document is not null and document <> ''")
    return own.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("document")))).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _frequency(word: str) -> Column:
    return F.size(F.filter("t", lambda x: x == word)).cast("double")


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = K1, b: float = B, digits: int | None = None, keep: DataFrame | None = None) -> DataFrame:
    """Top k documents (id, score) for a query; a repeated query word counts each time; ties to the smaller id.

    Only the query's words are looked for: each document becomes one small row of
    its length and their frequencies, written once, and the statistics are sums over
    those rows; so texts are read once, and neither texts nor postings are shuffled.
    Scores are rounded to ``digits`` before they are ordered; of documents outside
    ``keep(id)`` only the statistics count.
    """
    spark = docs.sparkSession
    words = spark.range(1).select(tokens(F.lit(query)).alias("t")).first()[0]
    if not words:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    distinct = sorted(set(words))
    # The generator keeps the optimizer from splitting texts again for every use of t.
    own = docs.where("document is not null and document <> ''").select("id", F.explode(F.array(tokens(F.col("document")))).alias("t"))
    rows = written(own.select("id", F.size("t").cast("double").alias("dl"), *(_frequency(w).alias(f"tf{i}") for i, w in enumerate(distinct))))
    stats = rows.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *(F.count(F.when(F.col(f"tf{i}") > 0, 1)).cast("double").alias(f"df{i}") for i in range(len(distinct))))
    hit = F.lit(False)
    for i in range(len(distinct)):
        hit = hit | (F.col(f"tf{i}") > 0)
    found = rows.where(hit)
    if keep is not None:
        found = found.join(keep.select("id"), "id", "left_semi")
    both = found.crossJoin(F.broadcast(stats))  # one row of statistics
    norm = F.lit(k1) * (F.lit(1.0) - F.lit(b) + F.lit(b) * F.col("dl") / F.col("avgdl"))
    part = lambda i: F.when(F.col(f"tf{i}") > 0, idf(F.col("n"), F.col(f"df{i}")) * F.col(f"tf{i}") * F.lit(k1 + 1.0) / (F.col(f"tf{i}") + norm)).otherwise(F.lit(0.0))
    total = F.lit(0.0)
    for w in words:
        total = total + part(distinct.index(w))
    score = total if digits is None else F.round(total, digits)
    return both.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(max(0, k))


def vocabulary_size(docs: DataFrame) -> DataFrame:
    return postings(docs).agg(F.countDistinct("term").alias("terms"))


def document_frequency(docs: DataFrame) -> DataFrame:
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
