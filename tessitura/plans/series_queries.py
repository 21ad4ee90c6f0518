"""Queries on samples: every sample-wise operator, over all events."""

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import samples as fs
from ..operators import series
from .base import LOWEST, SAMPLES, TONIC, samples

W = "(PARTITION BY rec_id ORDER BY idx"


def sql(select: str) -> str:
    return f"WITH {SAMPLES} {select}"


@query("hz_to_cents", sql(f"SELECT rec_id, idx, round(log2((value + 1e-16) / {TONIC}) * 1200, 6) AS cents FROM samples"))
def hz_to_cents(spark, sf):
    return samples(spark, sf).select("rec_id", "idx", F.round(fs.hz_to_cents(F.col("value"), F.lit(TONIC)), 6).alias("cents"))


@query("cents_to_hz", sql(f"SELECT rec_id, idx, round({TONIC} * pow(2, value / 1200), 6) AS hz FROM samples"))
def cents_to_hz(spark, sf):
    return samples(spark, sf).select("rec_id", "idx", F.round(fs.cents_to_hz(F.col("value"), F.lit(TONIC)), 6).alias("hz"))


@query("octave_fold", sql("SELECT rec_id, idx, round(c - floor(c / 1200) * 1200, 6) AS folded FROM (SELECT *, round(log2((value + 1e-16) / 50) * 1200, 6) AS c FROM samples)"))
def octave_fold(spark, sf):
    cents = F.round(fs.hz_to_cents(F.col("value"), F.lit(TONIC)), 6)
    return samples(spark, sf).select("rec_id", "idx", F.round(fs.octave_fold(cents), 6).alias("folded"))


@query("quantize_pitch", sql("SELECT rec_id, idx, floor(round(log2((value + 1e-16) / 50) * 1200, 6) / 100.0 + 0.5) * 100.0 AS level FROM samples"))
def quantize_pitch(spark, sf):
    cents = F.round(fs.hz_to_cents(F.col("value"), F.lit(TONIC)), 6)
    return samples(spark, sf).select("rec_id", "idx", fs.quantize_pitch(cents, 1200, 12).alias("level"))


@query("quantize_level", sql("SELECT rec_id, idx, list_filter(range(-800, 2500, 100), lambda n: n NOT IN (100, 600) AND abs(c - n) <= 35)[1]::INT AS level FROM (SELECT *, round(log2((value + 1e-16) / 50) * 1200, 6) AS c FROM samples)"))
def quantize_level(spark, sf):
    cents = F.round(fs.hz_to_cents(F.col("value"), F.lit(TONIC)), 6)
    return samples(spark, sf).select("rec_id", "idx", fs.quantize_level(cents, 35.0, ignore=(100, 600)).alias("level"))


@query("sample_hop", sql("SELECT rec_id, round(max(t) FILTER (idx = 1) - max(t) FILTER (idx = 0), 6) AS hop FROM samples GROUP BY rec_id"))
def sample_hop(spark, sf):
    return series.sample_hop(samples(spark, sf)).select("rec_id", F.round("hop", 6).alias("hop"))


@query("downsample", sql("SELECT rec_id, idx // 3 AS idx, value FROM (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n FROM samples) WHERE idx % 3 = 0 AND idx < n // 3 * 3"))
def downsample(spark, sf):
    return series.downsample(samples(spark, sf), 3).select("rec_id", "idx", "value")


@query("filter_silence", sql(f"SELECT rec_id, row_number() OVER {W}) - 1 AS idx, value, (idx - coalesce(lag(idx) OVER {W}), -1) - 1)::BIGINT AS gap FROM samples WHERE value > {LOWEST}"))
def filter_silence(spark, sf):
    return series.filter_silence(samples(spark, sf), LOWEST).select("rec_id", "idx", "value", "gap")


@query("nearest_sample", sql("SELECT q.rec_id, q.k, (SELECT arg_min(idx, struct_pack(d := abs(s.t - q.at), i := s.idx)) FROM samples s WHERE s.rec_id = q.rec_id) AS idx FROM (SELECT rec_id, lo + (hi - lo) * k / 8.0 AS at, k FROM (SELECT rec_id, min(t) AS lo, max(t) AS hi FROM samples GROUP BY rec_id), (SELECT unnest(range(0, 9)) AS k)) q"))
def nearest_sample(spark, sf):
    s = samples(spark, sf)
    spans = s.groupBy("rec_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    times = spans.select("rec_id", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("k"))
    times = times.select("rec_id", "k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / F.lit(8.0)).alias("at"))
    return series.nearest_sample(s, times).join(times, ["rec_id", "at"]).select("rec_id", "k", "idx")


@query("running_min_max", sql(f"SELECT rec_id, idx, min(value) OVER {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS low, max(value) OVER {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS high FROM samples"))
def running_min_max(spark, sf):
    return series.running_extremes(samples(spark, sf), 5)


@query("running_std_local", sql(f"SELECT rec_id, idx, round(stddev_pop(value) OVER {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 5) AS std FROM samples"))
def running_std_local(spark, sf):
    return series.running_std(samples(spark, sf), 3).select("rec_id", "idx", F.round("std", 5).alias("std"))


_COMPAT = f"""SELECT rec_id, idx, round(CASE WHEN idx >= 3 AND idx < n - 3 THEN sqrt(avg((value - m) * (value - m)) OVER {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) ELSE 0 END, 5) AS std
FROM (SELECT *, CASE WHEN idx >= 3 AND idx < n - 3 THEN avg(value) OVER {W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) ELSE 0 END AS m FROM (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n FROM samples))"""


@query("running_std_compat", sql(_COMPAT))
def running_std_compat(spark, sf):
    return series.running_std(samples(spark, sf), 3, compat=True).select("rec_id", "idx", F.round("std", 5).alias("std"))


@query("local_variance", sql(f"SELECT rec_id, idx, round(CASE WHEN count(*) OVER a = 4 AND count(*) OVER b = 4 THEN least(var_pop(value) OVER a, var_pop(value) OVER b) END, 8) AS variance FROM samples WINDOW a AS {W} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING), b AS {W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"))
def local_variance(spark, sf):
    return series.local_variance(samples(spark, sf), 4).select("rec_id", "idx", F.round("variance", 8).alias("variance"))


@query("peaks_valleys", sql(f"SELECT rec_id, idx, value, CASE WHEN l > 0 THEN 'peak' ELSE 'valley' END AS kind FROM (SELECT *, value - lag(value) OVER {W}) AS l, lead(value) OVER {W}) - value AS r FROM samples) WHERE l > 0 AND r < 0 OR l < 0 AND r > 0"))
def peaks_valleys(spark, sf):
    return series.peaks_valleys(samples(spark, sf))


@query("group_runs", sql(f"SELECT rec_id, min(idx) AS first, max(idx) AS last FROM (SELECT rec_id, idx, idx - row_number() OVER {W}) AS g FROM samples WHERE value > 40) GROUP BY rec_id, g"))
def group_runs(spark, sf):
    return series.group_runs(samples(spark, sf).where(F.col("value") > 40))


@query("delay_embed", sql(f"SELECT * FROM (SELECT rec_id, idx, value AS x0, lead(value, 2) OVER {W}) AS x1, lead(value, 4) OVER {W}) AS x2 FROM samples) WHERE x2 IS NOT NULL"))
def delay_embed(spark, sf):
    points = series.delay_embed(samples(spark, sf), 3, 2)
    return points.select("rec_id", "idx", *[F.get("point", F.lit(k)).alias(f"x{k}") for k in range(3)])


@query("minmax_norm", sql("SELECT rec_id, idx, round((value - min(value) OVER p) / nullif(max(value) OVER p - min(value) OVER p, 0), 6) AS value FROM samples WINDOW p AS (PARTITION BY rec_id)"))
def minmax_norm(spark, sf):
    return series.minmax_norm(samples(spark, sf)).select("rec_id", "idx", F.round("value", 6).alias("value"))


@query("median_filter", sql(f"SELECT rec_id, idx, list_sort(list_concat(w, list_transform(range(0, 5 - len(w)), lambda k: 0.0)))[3] AS value FROM (SELECT rec_id, idx, list(value) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM samples)"))
def median_filter(spark, sf):
    return series.median_filter(samples(spark, sf), 5)


_GAPS = f"""SELECT rec_id, idx, round(CASE WHEN value <= 20 AND li IS NOT NULL AND ri IS NOT NULL AND ri - li - 1 <= 3 THEN lv + (rv - lv) * (idx - li) / (ri - li) ELSE value END, 6) AS value FROM (
  SELECT *, last_value(v IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv, last_value(i IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li,
  first_value(v IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rv, first_value(i IGNORE NULLS) OVER {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri
  FROM (SELECT *, CASE WHEN value > 20 THEN value END AS v, CASE WHEN value > 20 THEN idx END AS i FROM samples))"""


@query("fill_gaps", sql(_GAPS))
def fill_gaps(spark, sf):
    return series.fill_gaps(samples(spark, sf), 20.0, 3).select("rec_id", "idx", F.round("value", 6).alias("value"))


@query("phrases", sql(f"SELECT rec_id, phrase::BIGINT AS phrase, round(min(t), 3) AS s_time, round(max(t), 3) AS e_time, count(*) AS n FROM (SELECT *, sum(f) OVER {W} ROWS UNBOUNDED PRECEDING) - 1 AS phrase FROM (SELECT *, CASE WHEN t - lag(t) OVER {W}) <= 36000 THEN 0 ELSE 1 END AS f FROM samples)) GROUP BY rec_id, phrase"))
def phrases(spark, sf):
    return series.phrases(samples(spark, sf), 36000.0).select("rec_id", "phrase", F.round("s_time", 3).alias("s_time"), F.round("e_time", 3).alias("e_time"), "n")


@query("breath_phrases", sql(f"SELECT rec_id, min(idx) AS first, max(idx) AS last FROM (SELECT rec_id, idx, idx - row_number() OVER {W}) AS g FROM (SELECT rec_id, idx, avg(CASE WHEN value > 30 THEN 1.0 ELSE 0.0 END) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM samples) WHERE v > 0.5) GROUP BY rec_id, g"))
def breath_phrases(spark, sf):
    return series.breath_phrases(samples(spark, sf), 30.0, 2)


@query("note_runs", sql(f"SELECT rec_id, level, min(idx) AS first, max(idx) AS last FROM (SELECT *, sum(c) OVER {W} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN level IS NOT DISTINCT FROM lag(level) OVER {W}) THEN 0 ELSE 1 END AS c FROM (SELECT rec_id, idx, CASE WHEN value > 5 THEN floor(log2(value))::INT END AS level FROM samples))) WHERE level IS NOT NULL GROUP BY rec_id, run, level HAVING count(*) >= 2"))
def note_runs(spark, sf):
    level = F.when(F.col("value") > 5, F.floor(F.log2("value")).cast("int"))
    return series.note_runs(samples(spark, sf).select("rec_id", "idx", level.alias("level")), 2)


@query("seconds_to_hms", sql("SELECT rec_id, idx, concat_ws(':', s // 3600, s // 60 % 60, s % 60) AS hms FROM (SELECT rec_id, idx, floor(t)::BIGINT % 86400 AS s FROM samples)"))
def seconds_to_hms(spark, sf):
    return samples(spark, sf).select("rec_id", "idx", fs.seconds_to_hms(F.floor("t") % 86400).alias("hms"))
