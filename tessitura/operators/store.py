"""The relational store of patterns: file, pattern, match and network, as DataFrames.

Surrogate ids are row numbers over a total order, so a table that is computed again has the same ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import numbered

#: Schemas of the four tables.
FILE = "id BIGINT, filename STRING, mbid STRING, hasseed INT, raagaid STRING, tonic DOUBLE"
PATTERN = "id BIGINT, file_id BIGINT, start_time DOUBLE, end_time DOUBLE, pair_id BIGINT, isseed INT"
MATCH = "id BIGINT, source_id BIGINT, target_id BIGINT, distance DOUBLE, version INT"
NETWORK = "source_id BIGINT, target_id BIGINT, distance DOUBLE"


def load_discovery(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns and matches of discovered pairs (rec, rank, s1, e1, s2, e2, dist), seeds of their recordings.

    Each pair gives two patterns that name each other and two matches, versions -1 and -2. Ids count by (rec, rank, side).
    """
    rows = numbered(pairs, "k", "rec", "rank")
    a, b = (2 * F.col("k") + 1).cast("long"), (2 * F.col("k") + 2).cast("long")
    side = lambda i, p, s, e: F.struct(i.alias("id"), F.col("rec").cast("long").alias("file_id"), F.col(s).alias("start_time"), F.col(e).alias("end_time"), p.alias("pair_id"), F.lit(1).alias("isseed"))
    patterns = rows.select(F.explode(F.array(side(a, b, "s1", "e1"), side(b, a, "s2", "e2"))).alias("p")).select("p.*")
    link = lambda i, s, t, v: F.struct(i.alias("id"), s.alias("source_id"), t.alias("target_id"), F.col("dist").alias("distance"), F.lit(v).alias("version"))
    matches = rows.select(F.explode(F.array(link(a, a, b, -1), link(b, b, a, -2))).alias("m")).select("m.*")
    return patterns, matches


def load_search(found: DataFrame, first_pattern: int, first_match: int, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Patterns and matches of search results (source_id, rank, file_id, start_time, end_time, dist)."""
    rows = numbered(found, "k", "source_id", "rank")
    patterns = rows.select((F.col("k") + first_pattern).cast("long").alias("id"), "file_id", "start_time", "end_time", F.lit(None).cast("long").alias("pair_id"), F.lit(0).alias("isseed"))
    matches = rows.select((F.col("k") + first_match).cast("long").alias("id"), "source_id", (F.col("k") + first_pattern).cast("long").alias("target_id"), F.col("dist").alias("distance"), F.lit(version).alias("version"))
    return patterns, matches


def update_lookup(files: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` of files from a table (key, column) where that has it."""
    new = lookup.select(F.col(key).alias("_key"), F.col(column).alias("_new")).dropDuplicates(["_key"])
    joined = files.join(new, F.col(key) == F.col("_key"), "left").withColumn(column, F.coalesce("_new", column))
    return joined.select(*files.columns)


def with_hasseed(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """hasseed 1 for files with a seed pattern, else 0."""
    seeds = patterns.where(F.col("isseed") == 1).select(F.col("file_id").alias("_file")).distinct()
    joined = files.join(seeds, F.col("id") == F.col("_file"), "left")
    return joined.withColumn("hasseed", F.when(F.col("_file").isNotNull(), 1).otherwise(0)).select(*files.columns)


def pattern_labels(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """id, raagaid and mbid of each pattern's file."""
    f = files.select(F.col("id").alias("file_id"), "raagaid", "mbid")
    return patterns.select("id", "file_id").join(f, "file_id").select("id", "raagaid", "mbid")


def patterns_of(patterns: DataFrame, files: DataFrame, mbids: DataFrame) -> DataFrame:
    """Patterns of the files with given mbids."""
    wanted = files.join(mbids.select("mbid").distinct(), "mbid", "left_semi").select(F.col("id").alias("file_id"))
    return patterns.join(wanted, "file_id", "left_semi").select(*patterns.columns)


def neighbours(network: DataFrame, sources: DataFrame) -> DataFrame:
    return network.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def matches_of(matches: DataFrame, version: int, most: int | None = None) -> DataFrame:
    """Matches of a version by distance within each source, at most ``most``."""
    ranked = matches.where(F.col("version") == version).withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("distance", "target_id")))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def balanced_recordings(rows: DataFrame, group: str, artist: str, key: str, length: str) -> DataFrame:
    """As many recordings of each group as the smallest has, taken in turn from its artists, longest first."""
    turn = F.row_number().over(W.partitionBy(group, artist).orderBy(F.col(length).desc(), key))
    ranked = rows.withColumn("turn", turn).withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("turn", artist)))
    least = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return ranked.join(F.broadcast(least)).where(F.col("place") <= F.col("least")).select(group, artist, key, "place")


def empty(spark: SparkSession, columns: str) -> DataFrame:
    """A table of the store without rows, as after a reset."""
    return spark.createDataFrame([], columns)


def load_network(network: DataFrame, edges: DataFrame) -> DataFrame:
    """The network with more edges (a, b, weight) appended."""
    return network.unionByName(edges.select(F.col("a").cast("long").alias("source_id"), F.col("b").cast("long").alias("target_id"), F.col("weight").cast("double").alias("distance")))


def seeds(files: DataFrame, *columns: str) -> DataFrame:
    """Some columns of the files that have seeds."""
    return files.where(F.col("hasseed") == 1).select(*columns)


def phrase_spans(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """Patterns with the names of their files: id, file_id, filename, start_time, end_time."""
    named = files.select(F.col("id").alias("file_id"), "filename")
    return patterns.join(named, "file_id").select("id", "file_id", "filename", "start_time", "end_time")


def count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"))
