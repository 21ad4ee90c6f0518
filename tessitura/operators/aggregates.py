"""Histograms, statistics and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .lineage import numbered


def bin_of(value: Column, low: float, high: float, width: float) -> Column:
    """Bin from 0; the last bin holds its upper edge. Null outside."""
    n = round((high - low) / width)
    return F.when((value >= low) & (value <= high), F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(n - 1)).cast("int"))


def histogram(rows: DataFrame, key: str, value: Column, low: float, high: float, width: float) -> DataFrame:
    """All bins of each key with count and share of the fullest bin; ``edge`` is the bin's right end."""
    n = round((high - low) / width)
    counted = rows.select(F.col(key), bin_of(value, low, high, width).alias("bin")).where(F.col("bin").isNotNull()).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    spine = rows.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = spine.join(counted, [key, "bin"], "left").select(key, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    top = F.max("n").over(W.partitionBy(key))
    return full.select(key, "bin", (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("edge"), "n", F.when(top > 0, F.col("n") / top).otherwise(0.0).alias("share"))


def log_histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins between the least and greatest log10; values must be positive to count."""
    logs = rows.select(F.when(value > 0, F.log10(value)).alias("x")).where(F.col("x").isNotNull())
    ends = logs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1))).otherwise(0)
    return logs.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def stable_peaks(bins: DataFrame, key: str, least_drop: float) -> DataFrame:
    """Peaks of each key's histogram (key, bin, y) that stand more than ``least_drop`` above the lowest bins to both sides
    up to the next peaks."""
    w = W.partitionBy(key).orderBy("bin")
    marked = bins.withColumn("peak", ((F.col("y") > F.coalesce(F.lag("y").over(w), F.lit(-1.0))) & (F.col("y") > F.coalesce(F.lead("y").over(w), F.lit(-1.0)))).cast("int"))
    marked = marked.withColumn("part", F.sum("peak").over(w.rowsBetween(W.unboundedPreceding, 0)))
    lows = marked.groupBy(key, "part").agg(F.min(F.when(F.col("peak") == 0, F.col("y"))).alias("valley"), F.max(F.when(F.col("peak") == 1, F.col("bin"))).alias("bin"), F.max(F.when(F.col("peak") == 1, F.col("y"))).alias("y"))
    order = W.partitionBy(key).orderBy("part")
    lows = lows.withColumn("left", F.coalesce(F.lag("valley").over(order), F.lit(0.0))).withColumn("right", F.coalesce("valley", F.lit(0.0)))
    return lows.where(F.col("bin").isNotNull() & (F.col("y") - F.col("left") > least_drop) & (F.col("y") - F.col("right") > least_drop)).select(key, "bin", "y")


def stratified_sample(rows: DataFrame, key: str, stratum: Column, n: int, order: Column) -> DataFrame:
    """``n`` rows, taken in turn from the strata; within a stratum in the given order (such as a seeded hash)."""
    placed = rows.withColumn("stratum", stratum)
    placed = placed.withColumn("turn", F.row_number().over(W.partitionBy("stratum").orderBy(order, key)))
    return placed.orderBy("turn", "stratum").limit(n).drop("turn")


def entity_stats(rows: DataFrame, recording: str, entities: Sequence[str]) -> DataFrame:
    """For each entity column: distinct values, rows that have one, recordings that have one."""
    columns = [F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("value")) for e in entities]
    long = rows.select(F.col(recording).alias("rec"), F.explode(F.array(*columns)).alias("c")).select("rec", "c.entity", "c.value")
    return long.groupBy("entity").agg(F.countDistinct("value").alias("total_unique"), F.count("value").alias("total_rels"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("rec"))).alias("total_recs"))


def frame_aggregate(samples: DataFrame, size: int) -> DataFrame:
    """Mean and variance (population) of blocks of ``size`` samples; the last whole block is left out."""
    n = F.count(F.lit(1)).over(W.partitionBy("rec_id"))
    last = F.floor((F.col("n") - 1) / size)
    kept = samples.withColumn("n", n).withColumn("block", F.floor(F.col("idx") / size).cast("long")).where(F.col("block") < last)
    return kept.groupBy("rec_id", "block").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))


def transitions(rows: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """How often each state follows each within a key."""
    follows = F.lead(state).over(W.partitionBy(key).orderBy(*order))
    pairs = rows.select(F.col(state).alias("from_state"), follows.alias("to_state")).where(F.col("to_state").isNotNull())
    return pairs.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def phase_surface(samples: DataFrame, lag: int, low: float, width: float) -> DataFrame:
    """Counts of (bin now, bin ``lag`` samples before) of each recording, as sparse rows."""
    before = F.lag("value", lag).over(W.partitionBy("rec_id").orderBy("idx"))
    cell = lambda v: F.floor((v - low) / width).cast("int")
    pairs = samples.select("rec_id", cell(F.col("value")).alias("i"), cell(before).alias("j")).where(F.col("j").isNotNull())
    return pairs.groupBy("rec_id", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def ratio_histogram(notes: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """Histogram of greater over smaller of all pairs of a key's values, from counts of equal values."""
    counts = notes.groupBy(key, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    a, b = counts.alias("a"), counts.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.v") <= F.col("b.v")) & (F.col("a.v") > 0))
    times = F.when(F.col("a.v") == F.col("b.v"), F.col("a.n") * (F.col("a.n") - 1) / 2).otherwise(F.col("a.n") * F.col("b.n"))
    ratio = F.floor(F.col("b.v") / F.col("a.v") / F.lit(width)).cast("long")
    return pairs.select(ratio.alias("bin"), times.cast("long").alias("n")).groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count(F.lit(1)).alias("n"))


def accuracy(rows: DataFrame, fold: str, truth: str, guess: str) -> DataFrame:
    """Mean of the folds' shares of right guesses."""
    per = rows.groupBy(fold).agg(F.avg(F.when(F.col(truth) == F.col(guess), 1.0).otherwise(0.0)).alias("share"))
    return per.agg(F.avg("share").alias("accuracy"), F.count(F.lit(1)).alias("folds"))


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """U statistic and normal p-value (two-sided, with the correction for ties) of two groups 0 and 1.

    Ranks come from counts of equal values in order, so rows are shuffled once, pre-aggregated.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"))
    before = F.coalesce(F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("rank", before + (F.col("n") + 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("a")).alias("r"), F.sum("a").alias("n1"), F.sum("n").alias("n"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"))
    n1, n2, n = F.col("n1"), F.col("n") - F.col("n1"), F.col("n")
    u = F.col("r") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), ((u - n1 * n2 / 2.0) / sd).alias("z"))


def top_n(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def kept_counts(rows: DataFrame, key: str, removed: Column) -> DataFrame:
    """key, total and kept: rows, and rows that ``removed`` doesn't mark."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(removed, F.lit(False))).alias("kept"))


def most_common(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column with their counts n and rank, the most frequent first. Only the counts are put in order."""
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts.withColumn("_less", -F.col("n")), "rank", "_less", column).drop("_less").withColumn("rank", F.col("rank") + 1)


def line_counts(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, files and lines: texts and their lines that aren't blank."""
    lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda v: v.rlike(r"[^\x09-\x0D\x20]")))
    return files.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum(lines).alias("lines"))


def distance_histogram(rows: DataFrame, key: str, distance: str, step: float, bins: int) -> DataFrame:
    """key, bin and n over ``bins`` bins of width ``step`` from 0; distances beyond the last are left out."""
    counted = rows.select(key, distance, F.floor(F.col(distance) / step).cast("int").alias("bin")).where(F.col(distance) < step * bins)
    return counted.groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
