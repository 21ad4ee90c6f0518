"""Queries that walk through recordings, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import melody, series
from .base import SAMPLES, samples


def sql(select: str) -> str:
    return f"WITH RECURSIVE {SAMPLES} {select}"


@query("octave_error_fix", sql("""SELECT rec_id, idx, round(o, 6) AS value FROM walk""").replace(SAMPLES, SAMPLES + """, walk AS (SELECT rec_id, idx, value AS o FROM samples WHERE idx = 0 UNION ALL
  SELECT s.rec_id, s.idx, CASE WHEN w.o > 0 AND abs(s.value / w.o - 0.5) < 0.05 THEN s.value * 2 WHEN w.o > 0 AND abs(s.value / w.o - 4) < 0.1 THEN s.value / 4 WHEN w.o > 0 AND abs(s.value / w.o - 3) < 0.1 THEN s.value / 3 WHEN w.o > 0 AND abs(s.value / w.o - 2) < 0.1 THEN s.value / 2 ELSE s.value END
  FROM walk w JOIN samples s ON s.rec_id = w.rec_id AND s.idx = w.idx + 1)"""))
def octave_error_fix(spark, sf):
    return melody.octave_error_fix(samples(spark, sf)).select("rec_id", "idx", F.round("value", 6).alias("value"))


@query("note_candidates", sql("""SELECT rec_id, pitch, min(idx) AS first, max(idx) AS last FROM (SELECT *, sum(f) OVER (PARTITION BY rec_id, pitch ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT rec_id, idx, pitch, CASE WHEN idx - lag(idx) OVER (PARTITION BY rec_id, pitch ORDER BY idx) - 1 <= 2 THEN 0 ELSE 1 END AS f FROM samples, (SELECT unnest([20.0::DOUBLE, 60.0::DOUBLE, 120.0::DOUBLE]) AS pitch) WHERE abs(value - pitch) <= 25)) GROUP BY rec_id, pitch, run HAVING max(idx) - min(idx) + 1 >= 3"""))
def note_candidates(spark, sf):
    return melody.note_candidates(samples(spark, sf), [20.0, 60.0, 120.0], 25.0, 3, 2)


@query("flat_variance", sql("SELECT rec_id, min(idx) AS first, max(idx) AS last FROM (SELECT rec_id, idx, idx - row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS g FROM (SELECT rec_id, idx, CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN least(var_pop(value) OVER a, var_pop(value) OVER b) END AS v FROM samples WINDOW a AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), b AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE v <= 600.001) GROUP BY rec_id, g"))
def flat_variance(spark, sf):
    return melody.flat_variance(series.local_variance(samples(spark, sf), 4), 600.001)


@query("flat_vicinity", sql("SELECT rec_id, min(idx) AS first, max(idx) AS last FROM (SELECT rec_id, idx, idx - row_number() OVER (PARTITION BY rec_id ORDER BY idx) AS g FROM samples s WHERE EXISTS (SELECT 1 FROM (SELECT rec_id, median(value) AS pitch FROM samples GROUP BY rec_id UNION ALL SELECT rec_id, max(value) FROM samples GROUP BY rec_id) p WHERE p.rec_id = s.rec_id AND abs(value - pitch) < 15)) GROUP BY rec_id, g"))
def flat_vicinity(spark, sf):
    s = samples(spark, sf)
    pitches = s.groupBy("rec_id").agg(F.array(F.median("value"), F.max("value")).alias("p")).select("rec_id", F.explode("p").alias("pitch"))
    return melody.flat_vicinity(s, pitches, 15.0)


@query("keep_longest")
def keep_longest(spark, sf):
    return melody.keep_longest(melody.note_candidates(samples(spark, sf), [20.0, 60.0, 120.0], 25.0, 3, 2))


@query("resample")
def resample(spark, sf):
    """Samples on a clock of six hours."""
    return melody.resample(samples(spark, sf), 21_600.0, 5.0).select("rec_id", "idx", F.round("value", 5).alias("value"))


@query("clean_chain")
def clean_chain(spark, sf):
    """Jumps fixed, short gaps filled, median and Gaussian filters."""
    s = samples(spark, sf).withColumn("value", F.when(F.col("value") > 5, F.col("value")).otherwise(0.0))
    fixed = melody.jump_fix(s, 0.0, 1200.0, 3)
    filled = series.fill_gaps(fixed, 0.0, 2).join(fixed.select("rec_id", "idx", "t"), ["rec_id", "idx"])
    smooth = series.median_filter(filled, 3).join(fixed.select("rec_id", "idx", "t"), ["rec_id", "idx"])
    return melody.gaussian_smooth(smooth, 1.0).select("rec_id", "idx", F.round("value", 5).alias("value"))


@query("transcribe")
def transcribe(spark, sf):
    level = F.when(F.col("value") > 5, F.floor(F.log2("value")))
    return melody.transcribe(samples(spark, sf).withColumn("value", level.cast("double")), 2, 3).select("rec_id", F.round("s_time", 3).alias("s_time"), F.round("e_time", 3).alias("e_time"), "level")


@query("piecewise_linear")
def piecewise_linear(spark, sf):
    return melody.piecewise_linear(samples(spark, sf), 10.0).withColumn("error", F.round("error", 5))


@query("section_runs")
def section_runs(spark, sf):
    return melody.section_runs(samples(spark, sf).select("rec_id", "idx", F.when(F.col("value") > 50, 1).otherwise(0).alias("label")), 2)
