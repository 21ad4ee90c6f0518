"""The streams' queries over all events as a finished stream: a batch of the same plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..streaming import queries as streams
from .base import table


def events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("rec_id"), F.col("ts").cast("timestamp").alias("time"), "value")


@query("session_phrases", "SELECT rec_id, phrase_start, n, top FROM (SELECT user_id AS rec_id, epoch_us(min(ts)) AS phrase_start, count(*) AS n, max(value) AS top FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, k)")
def session_phrases(spark, sf):
    found = streams.session_phrases(events(spark, sf), "12 hours", "0 seconds")
    return found.select("rec_id", F.unix_micros("start").alias("phrase_start"), "n", "top")


@query("stream_histogram", "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, floor(value / 20)::INT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def stream_histogram(spark, sf):
    found = streams.stream_histogram(events(spark, sf), "6 hours", "0 seconds", 20.0)
    return found.select(F.unix_micros("start").alias("start"), "bin", "n")
