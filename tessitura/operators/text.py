"""Bags of words: counts, presence, tf-idf."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf. Terms are lower-cased words; null and empty texts have none."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
    return docs.select(F.col(key), F.explode(words).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def without_stop_words(counts: DataFrame, stops: DataFrame) -> DataFrame:
    return counts.join(stops.select("term").distinct(), "term", "left_anti")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def tfidf(counts: DataFrame, key: str, documents: DataFrame, normalize: bool = False) -> DataFrame:
    """key, term and ``tf * (ln(n / df) + 1)``; n counts all documents. Normalized rows have length 1."""
    n = documents.agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(document_frequency(counts), "term").join(F.broadcast(n))
    out = joined.select(key, "term", (F.col("tf") * (F.log(F.col("n") / F.col("df")) + 1.0)).alias("tfidf"))
    if normalize:
        length = out.groupBy(key).agg(F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf"))).alias("length"))
        out = out.join(length, key).select(key, "term", (F.col("tfidf") / F.col("length")).alias("tfidf"))
    return out
