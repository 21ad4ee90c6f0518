"""Queries on notes, pitch histograms and surfaces, over all events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query
from ..functions import arrays as fa
from ..operators import aggregates, graph, notes
from .base import SAMPLES, VECTORS, samples, table, vectors

NOTES = """notes AS (SELECT rec_id, sum(f) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS phrase, t AS s_time, e_time, level FROM (
  SELECT rec_id, idx, t, lead(t) OVER (PARTITION BY rec_id ORDER BY idx) AS e_time, floor(log2(value))::INT AS level, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id ORDER BY idx) <= 43200 THEN 0 ELSE 1 END AS f FROM samples WHERE value > 0.5) WHERE e_time IS NOT NULL)"""


def sql(select: str, *more: str) -> str:
    return "WITH " + ", ".join([SAMPLES, NOTES, *more]) + " " + select


def notes_of(spark, sf):
    w = W.partitionBy("rec_id").orderBy("idx")
    s = samples(spark, sf).where(F.col("value") > 0.5)
    s = s.select("rec_id", "idx", F.col("t").alias("s_time"), F.lead("t").over(w).alias("e_time"), F.floor(F.log2("value")).cast("int").alias("level"), F.when(F.col("t") - F.lag("t").over(w) <= 43_200, 0).otherwise(1).alias("f"))
    s = s.where(F.col("e_time").isNotNull()).withColumn("phrase", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return s.select("rec_id", "phrase", "s_time", "e_time", "level")


@query("note_duration_hist", sql("SELECT level, bin, n, round(n / sum(n) OVER (PARTITION BY level), 6) AS share FROM (SELECT level, least(floor((e_time - s_time) / 7200.0), 19)::INT AS bin, count(*) AS n FROM notes GROUP BY 1, 2)"))
def note_duration_hist(spark, sf):
    return notes.duration_histogram(notes_of(spark, sf), 7200.0, 20).withColumn("share", F.round("share", 6))


@query("note_freq_hist", sql("SELECT l::INT AS level, count(rec_id) AS n FROM (SELECT unnest(range(-1, 12)) AS l) LEFT JOIN notes ON level = l GROUP BY l"))
def note_freq_hist(spark, sf):
    return notes.level_histogram(notes_of(spark, sf), range(-1, 12))


@query("note_freq_hist_folded", sql("SELECT l::INT AS level, count(rec_id) AS n FROM (SELECT unnest(range(0, 3)) AS l) LEFT JOIN notes ON (level % 3 + 3) % 3 = l GROUP BY l"))
def note_freq_hist_folded(spark, sf):
    return notes.level_histogram(notes_of(spark, sf), range(3), 3)


@query("phrase_note_matrix", sql("SELECT rec_id, phrase::BIGINT AS phrase, level, round(coalesce(d / nullif(max(d) OVER (PARTITION BY rec_id, phrase), 0), 0), 6) AS share FROM (SELECT rec_id, phrase, level, sum(e_time - s_time) AS d FROM notes GROUP BY ALL)"))
def phrase_note_matrix(spark, sf):
    return notes.phrase_note_matrix(notes_of(spark, sf)).withColumn("share", F.round("share", 6))


@query("cum_note_salience", sql("SELECT rec_id, frame, arg_max(level, struct_pack(d := d, l := -level)) AS level FROM (SELECT rec_id, frame, level, round(sum(e_time - s_time), 3) AS d FROM (SELECT *, unnest(range(greatest(ceil((phrase - 4) / 2)::BIGINT, 0), floor(phrase / 2)::BIGINT + 1)) AS frame FROM notes) GROUP BY ALL) GROUP BY 1, 2"))
def cum_note_salience(spark, sf):
    return notes.salient_notes(notes_of(spark, sf), 5, 2)


@query("phrase_stats_melody", sql("SELECT rec_id, phrase::BIGINT AS phrase, notes, round(duration, 3) AS duration, round(longest, 3) AS longest, level FROM (SELECT rec_id, phrase, count(*) AS notes, max(e_time) - min(s_time) AS duration, max(e_time - s_time) AS longest, arg_max(level, struct_pack(d := e_time - s_time, l := -level)) AS level FROM notes GROUP BY 1, 2)"))
def phrase_stats_melody(spark, sf):
    return notes.phrase_statistics(notes_of(spark, sf)).select("rec_id", "phrase", "notes", F.round("duration", 3).alias("duration"), F.round("longest", 3).alias("longest"), "level")


@query("ioi_hist", sql("SELECT least(floor(g / 3600.0), 47)::INT AS bin, count(*) AS n FROM (SELECT s_time - lag(s_time) OVER (PARTITION BY rec_id ORDER BY s_time, level) AS g FROM notes) WHERE g IS NOT NULL GROUP BY 1"))
def ioi_hist(spark, sf):
    return notes.onset_gaps(notes_of(spark, sf), 3600.0, 48)


@query("fuzzy_gcd_hist", sql("SELECT bin, round(sum(w), 4) AS weight FROM (SELECT floor(g / k / 1800.0)::BIGINT + o AS bin, ([0.05, 0.2, 1.0, 0.2, 0.05]::DOUBLE[])[o + 3] AS w FROM (SELECT e_time - s_time AS g FROM notes), (SELECT unnest(range(1, 9)) AS k), (SELECT unnest(range(-2, 3)) AS o) WHERE g > 0) WHERE bin >= 0 GROUP BY bin"))
def fuzzy_gcd_hist(spark, sf):
    return notes.fuzzy_beat(notes_of(spark, sf), notes.duration(), 1800.0).select("bin", F.round("weight", 4).alias("weight"))


@query("phrase_notes", sql("SELECT n.rec_id, p.phrase::BIGINT AS phrase, count(*) AS notes FROM notes n JOIN (SELECT rec_id, phrase, min(s_time) AS a, max(s_time) AS b FROM notes GROUP BY 1, 2) p ON n.rec_id = p.rec_id AND n.s_time >= a AND n.e_time <= b GROUP BY 1, 2"))
def phrase_notes(spark, sf):
    every = notes_of(spark, sf)
    spans = every.groupBy("rec_id", "phrase").agg(F.min("s_time").alias("start"), F.max("s_time").alias("end"))
    return notes.notes_in_phrases(every.drop("phrase"), spans)


HIST = "hist AS (SELECT rec_id, (floor(value / 10) % 12)::INT AS bin, count(*)::DOUBLE AS y FROM samples GROUP BY 1, 2)"


def hist(spark, sf):
    return samples(spark, sf).groupBy("rec_id", (F.floor(F.col("value") / 10) % 12).cast("int").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("y"))


@query("hist_unwrap", sql("SELECT rec_id, (CASE WHEN bin > low THEN bin - 12 ELSE bin END)::INT AS bin, y FROM (SELECT h.*, (SELECT arg_max(bin, struct_pack(a := -y, b := bin)) FROM hist g WHERE g.rec_id = h.rec_id) AS low FROM hist h)", HIST))
def hist_unwrap(spark, sf):
    return notes.unwrap_histogram(hist(spark, sf), "rec_id", 12)


@query("gauss_smooth_hist", sql("SELECT rec_id, bin, round(s / max(s) OVER (PARTITION BY rec_id), 6) AS y FROM (SELECT a.rec_id, a.bin, sum(b.y * exp(-0.5 * pow((a.bin - b.bin) / 1.5::DOUBLE, 2))) AS s FROM hist a JOIN hist b ON a.rec_id = b.rec_id AND abs(a.bin - b.bin) <= 3 GROUP BY 1, 2)", HIST))
def gauss_smooth_hist(spark, sf):
    return notes.smooth_histogram(hist(spark, sf), "rec_id", 1.5, 3).withColumn("y", F.round("y", 6))


PITCHES = "pitches AS (SELECT rec_id, round(log2(value / 50) * 1200, 3) AS pitch FROM samples WHERE value > 5)"


def pitches(spark, sf):
    return samples(spark, sf).where(F.col("value") > 5).select("rec_id", F.round(F.log2(F.col("value") / 50) * 1200, 3).alias("pitch"))


@query("extend_octaves", sql("SELECT rec_id, round(pitch + 1200 * o, 3) AS pitch FROM pitches, (SELECT unnest(range(-1, 3)) AS o)", PITCHES))
def extend_octaves(spark, sf):
    return notes.extend_octaves(pitches(spark, sf)).withColumn("pitch", F.round("pitch", 3))


@query("tonic_finetune", sql("SELECT rec_id, round(CASE WHEN abs(o) < 100 THEN 50 * pow(2, o / 1200) ELSE 50 END, 6) AS tonic FROM (SELECT s.rec_id, (SELECT arg_min(pitch, struct_pack(a := abs(pitch), b := pitch)) FROM pitches p WHERE p.rec_id = s.rec_id) AS o FROM (SELECT DISTINCT rec_id FROM samples) s)", PITCHES))
def tonic_finetune(spark, sf):
    tonics = samples(spark, sf).select("rec_id").distinct().withColumn("tonic", F.lit(50.0))
    return notes.tuned_tonic(tonics, pitches(spark, sf).withColumnRenamed("pitch", "cents")).withColumn("tonic", F.round("tonic", 6))


@query("valid_notes", sql("SELECT rec_id, array_to_string(list_sort(v), ',') AS valid, array_to_string(list_filter(range(0, 12), lambda n: NOT list_contains(v, n)), ',') AS ignored FROM (SELECT rec_id, list(DISTINCT ((round(pitch / 100) % 12 + 12) % 12)::INT) AS v FROM pitches GROUP BY 1)", PITCHES))
def valid_notes(spark, sf):
    return notes.valid_levels(pitches(spark, sf)).select("rec_id", F.array_join("valid", ",").alias("valid"), F.array_join("ignored", ",").alias("ignored"))


SURFACE = "p AS (SELECT rec_id, i, j, n / sum(n) OVER (PARTITION BY rec_id) AS v FROM (SELECT rec_id, i, j, count(*)::DOUBLE AS n FROM (SELECT rec_id, floor(value / 25)::INT AS i, floor(lag(value, 2) OVER (PARTITION BY rec_id ORDER BY idx) / 25)::INT AS j FROM samples) WHERE j IS NOT NULL GROUP BY 1, 2, 3))"


@query("surface_distances", sql("SELECT a, b, round(sqrt(greatest(0, qa + qb - 2 * dot)), 6) AS euclidean, round(-ln(o), 6) AS bhattacharyya FROM (SELECT x.rec_id AS a, y.rec_id AS b, sum(x.v * y.v) AS dot, sum(sqrt(x.v * y.v)) AS o FROM p x JOIN p y ON x.i = y.i AND x.j = y.j AND x.rec_id < y.rec_id GROUP BY 1, 2) JOIN (SELECT rec_id AS a, sum(v * v) AS qa FROM p GROUP BY 1) USING (a) JOIN (SELECT rec_id AS b, sum(v * v) AS qb FROM p GROUP BY 1) USING (b)", SURFACE))
def surface_distances(spark, sf):
    return notes.surface_distances(aggregates.phase_surface(samples(spark, sf), 2, 0.0, 25.0), digits=6)


@query("phase_knn", sql("SELECT a, b, rank::INT AS rank FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM (SELECT a, b, round(-ln(o), 9) AS d FROM (SELECT x.rec_id AS a, y.rec_id AS b, sum(sqrt(x.v * y.v)) AS o FROM p x JOIN p y ON x.i = y.i AND x.j = y.j AND x.rec_id <> y.rec_id GROUP BY 1, 2))) WHERE rank <= 3", SURFACE))
def phase_knn(spark, sf):
    return notes.nearest_surfaces(aggregates.phase_surface(samples(spark, sf), 2, 0.0, 25.0), 3, 9).select("a", "b", "rank")


@query("completeness_stats", "SELECT field, round(count(value) / count(*), 6) AS share, count(DISTINCT value) AS different FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1")
def completeness_stats(spark, sf):
    return notes.completeness(table(spark, sf, "documents"), ["lang", "source"]).withColumn("share", F.round("share", 6))


@query("rank_recurring", "WITH m AS (SELECT doc_id // 25 AS community, lang AS label, source AS rec FROM documents), c AS (SELECT community, sum(n)::BIGINT AS size, sum(r * n) / sum(n) AS x FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, label) AS r FROM (SELECT community, label, count(*) AS n FROM m GROUP BY 1, 2)) GROUP BY 1), d AS (SELECT community, sum(r * n) / sum(n) AS y FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, rec) AS r FROM (SELECT community, rec, count(*) AS n FROM m GROUP BY 1, 2)) GROUP BY 1) SELECT community, size, round(size * x * y, 2) AS score FROM c JOIN d USING (community)")
def rank_recurring(spark, sf):
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 25).cast("long").alias("community"), F.col("lang").alias("label"), F.col("source").alias("rec"))
    return notes.rank_recurring(docs)


@query("single_label_communities", "SELECT community, count(*) AS size FROM (SELECT doc_id // 3 AS community, source AS label FROM documents) GROUP BY 1 HAVING count(DISTINCT label) = 1")
def single_label_communities(spark, sf):
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 3).cast("long").alias("community"), F.col("source").alias("label"))
    return graph.single_label_communities(docs)


@query("peakiness", "WITH " + VECTORS + " SELECT vec_id, round(list_avg(y) / exp(list_avg(list_transform(y, lambda v: ln(v)))), 6) AS peakiness FROM (SELECT vec_id, list_transform(x, lambda v: abs(v) + 0.01::DOUBLE) AS y FROM vectors)")
def peakiness(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(fa.let(F.transform("x", lambda v: F.abs(v) + 0.01), fa.peakiness), 6).alias("peakiness"))
