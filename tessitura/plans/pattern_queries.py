"""Queries on pattern lists, their store and their counts, over all rows of their tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query
from ..functions import arrays as fa
from ..operators import aggregates, graph, store, subsequences
from .base import SAMPLES, VECTORS, samples, table, vectors

LENGTH = 8
FLAT = "marked AS (SELECT *, value < 20 AS flat FROM samples), listed AS (SELECT rec_id, idx AS sub_id FROM (SELECT rec_id, idx, sum(flat::INT) OVER w AS n, count(*) OVER w AS size FROM marked WINDOW w AS (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE size = 8 AND n >= 0.5 * 8)"


def sql(select: str, *more: str) -> str:
    return "WITH " + ", ".join([SAMPLES, *more]) + " " + select


def marked(spark, sf):
    return samples(spark, sf).withColumn("flat", F.col("value") < 20)


@query("bl_flat_file", sql("SELECT rec_id, sub_id FROM listed", FLAT))
def bl_flat_file(spark, sf):
    return subsequences.flat_windows(marked(spark, sf), LENGTH, 0.5)


@query("drop_blacklisted", sql("SELECT rec_id, idx AS sub_id FROM (SELECT rec_id, idx, count(*) OVER (PARTITION BY rec_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS size FROM samples) w WHERE size = 8 AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.rec_id = w.rec_id AND l.sub_id = w.idx)", FLAT))
def drop_blacklisted(spark, sf):
    every = subsequences.sliding_windows(samples(spark, sf), LENGTH).select("rec_id", "sub_id")
    return subsequences.without_listed(every, subsequences.flat_windows(marked(spark, sf), LENGTH, 0.5))


@query("near_pair", sql("SELECT a.rec_id, a.idx AS i, b.idx AS j, abs(a.t - b.t) < 43200 AS near FROM samples a JOIN samples b ON a.rec_id = b.rec_id AND b.idx - a.idx = 2"))
def near_pair(spark, sf):
    s = samples(spark, sf).withColumn("t2", F.lead("t", 2).over(W.partitionBy("rec_id").orderBy("idx"))).where(F.col("t2").isNotNull())
    return s.select("rec_id", F.col("idx").alias("i"), (F.col("idx") + 2).alias("j"), subsequences.near(F.col("t"), F.col("t2"), 43_200).alias("near"))


@query("is_flat_range", "WITH " + VECTORS + " SELECT vec_id, list_max(y) - list_min(y) < 300 OR list_min(y) < -1200 AS flat FROM (SELECT vec_id, list_transform(x, lambda v: v * 800) AS y FROM vectors)")
def is_flat_range(spark, sf):
    y = F.transform("x", lambda v: v * 800)
    return vectors(spark, sf).select("vec_id", y.alias("y")).select("vec_id", subsequences.flat_range(F.col("y")).alias("flat"))


@query("downsample_subseq", "WITH " + VECTORS + " SELECT vec_id, len(y) AS n, round(list_sum(y), 6) AS total FROM (SELECT vec_id, list_filter(x, lambda v, i: (i - 1) % 3 = 0) AS y FROM vectors)")
def downsample_subseq(spark, sf):
    y = vectors(spark, sf).select("vec_id", subsequences.thinned(F.col("x"), 3).alias("y"))
    return y.select("vec_id", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


PHRASES = "phrased AS (SELECT *, sum(f) OVER (PARTITION BY rec_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS phrase FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY rec_id ORDER BY idx) <= 129600 THEN 0 ELSE 1 END AS f FROM samples))"


@query("windows_in_phrases", sql("SELECT rec_id, phrase::BIGINT AS phrase, idx AS sub_id, round(m, 6) AS mean FROM (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER f AS size, avg(value) OVER f AS m FROM phrased WINDOW w AS (PARTITION BY rec_id, phrase ORDER BY idx), f AS (PARTITION BY rec_id, phrase ORDER BY idx ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)) WHERE pos % 3 = 0 AND size = 4", PHRASES))
def windows_in_phrases(spark, sf):
    w = W.partitionBy("rec_id").orderBy("idx")
    s = samples(spark, sf).withColumn("f", F.when(F.col("t") - F.lag("t").over(w) <= 129_600, 0).otherwise(1))
    s = s.withColumn("phrase", F.sum("f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    found = subsequences.windows_in_phrases(s, 4, 3)
    return found.select("rec_id", F.col("phrase").cast("long").alias("phrase"), "sub_id", F.round(fa.mean(F.col("data")), 6).alias("mean"))


@query("removed_pattern_counts", sql("SELECT rec_id, count(*) AS total, count(*) FILTER (NOT flat) AS kept FROM marked GROUP BY 1", "marked AS (SELECT *, value < 20 AS flat FROM samples)"))
def removed_pattern_counts(spark, sf):
    return aggregates.kept_counts(marked(spark, sf), "rec_id", F.col("flat"))


@query("histogram_sorted", "SELECT event_type, n, row_number() OVER (ORDER BY n DESC, event_type) AS rank FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def histogram_sorted(spark, sf):
    return aggregates.most_common(table(spark, sf, "events"), "event_type").withColumn("rank", F.col("rank").cast("long"))


@query("annotation_counts", "SELECT source, count(*) AS files, sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x09-\\x0D\\x20]'))))::BIGINT AS lines FROM documents GROUP BY 1".replace("\\\\", "\\"))
def annotation_counts(spark, sf):
    return aggregates.line_counts(table(spark, sf, "documents"), "source", "text")


@query("raga_dist_hist", "WITH " + VECTORS + ", d AS (SELECT label, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(x[i] - y[i], 2)))), 9) AS dist FROM (SELECT label, x, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM vectors) WHERE y IS NOT NULL) SELECT label, floor(dist / 0.05)::INT AS bin, count(*) AS n FROM d WHERE dist < 2.45 GROUP BY 1, 2")
def raga_dist_hist(spark, sf):
    """Distances of successive vectors of a label over 49 fixed bins."""
    v = vectors(spark, sf).withColumn("y", F.lead("x").over(W.partitionBy("label").orderBy("vec_id"))).where(F.col("y").isNotNull())
    d = v.select("label", F.round(F.sqrt(fa.sequence_distance(F.col("x"), F.col("y"))), 9).alias("dist"))
    return aggregates.distance_histogram(d, "label", "dist", 0.05, 49)


@query("node_order", "SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS rank FROM (SELECT node, count(*) AS degree FROM (SELECT DISTINCT l_orderkey, l_partkey AS node FROM lineitem) GROUP BY 1)")
def node_order(spark, sf):
    parts = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("node")).distinct()
    return graph.ordered_nodes(parts.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degree").withColumn("rank", F.col("rank").cast("long"))


@query("sql_phrase_span", "SELECT o_orderkey AS id, c_name AS filename, o_totalprice::DOUBLE AS start_time, o_totalprice::DOUBLE + 1 AS end_time FROM orders JOIN customer ON o_custkey = c_custkey")
def sql_phrase_span(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"))
    price = F.col("o_totalprice").cast("double")
    patterns = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), price.alias("start_time"), (price + 1).alias("end_time"))
    return store.phrase_spans(patterns, files).select("id", "filename", "start_time", "end_time")


@query("sql_count", "SELECT count(*) AS n FROM orders")
def sql_count(spark, sf):
    return store.count(table(spark, sf, "orders"))


@query("sql_load_network", "SELECT l_orderkey AS source_id, l_partkey AS target_id, l_quantity::DOUBLE AS distance FROM lineitem UNION ALL SELECT o_orderkey, o_custkey, 0 FROM orders")
def sql_load_network(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").cast("double").alias("weight"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.lit(0.0).alias("weight"))
    return store.load_network(store.load_network(store.empty(spark, store.NETWORK), lines), orders)


@query("sql_projection_filter", "SELECT c_custkey AS id, c_name AS filename FROM customer WHERE c_nationkey % 5 = 1")
def sql_projection_filter(spark, sf):
    files = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("filename"), F.when(F.col("c_nationkey") % 5 == 1, 1).otherwise(0).alias("hasseed"))
    return store.seeds(files, "id", "filename")
