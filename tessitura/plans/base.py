"""The driver's tables seen as series and subsequences, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import series

#: Samples above this are voiced; the tonic of every recording.
LOWEST, TONIC = 5.0, 50.0

SAMPLES = "samples AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, epoch_us(ts) / 1000000.0 AS t, value FROM events)"
VECTORS = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0)
    return series.index_series(events, "user_id", seconds, F.col("value"), "event_id")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def rounded(column, digits: int = 6):
    return F.round(column, digits)
