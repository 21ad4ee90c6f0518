"""Operators on long tables of samples: rec_id, idx, t (seconds), value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

def by_time():
    """Samples of a recording in order."""
    return W.partitionBy("rec_id").orderBy("idx")



def index_series(rows: DataFrame, rec: str, time: Column, value: Column, *ties: str) -> DataFrame:
    """A sample table from any rows; ``ties`` order samples of the same time."""
    order = W.partitionBy(rec).orderBy(time, *ties)
    return rows.select(F.col(rec).alias("rec_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), time.alias("t"), value.cast("double").alias("value"))


def sample_hop(samples: DataFrame) -> DataFrame:
    """Seconds between the first two samples of each recording; null if there is one only."""
    first = samples.where(F.col("idx") < 2).groupBy("rec_id").agg(F.min_by("t", "idx").alias("a"), F.max_by("t", "idx").alias("b"), F.count(F.lit(1)).alias("n"))
    return first.select("rec_id", F.when(F.col("n") > 1, F.col("b") - F.col("a")).alias("hop"))


def downsample(samples: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th sample, without the last if its stride isn't whole."""
    n = F.count(F.lit(1)).over(W.partitionBy("rec_id"))
    kept = samples.withColumn("n", n).where((F.col("idx") % factor == 0) & (F.col("idx") < F.floor(F.col("n") / factor) * factor))
    return kept.select("rec_id", F.floor(F.col("idx") / factor).cast("long").alias("idx"), "t", "value")


def filter_silence(samples: DataFrame, lowest: float) -> DataFrame:
    """Samples above ``lowest``, with the number of samples dropped just before each as ``gap``; idx is numbered anew."""
    kept = samples.where(F.col("value") > lowest)
    gap = F.col("idx") - F.coalesce(F.lag("idx").over(by_time()), F.lit(-1)) - 1
    return kept.select("rec_id", (F.row_number().over(by_time()) - 1).cast("long").alias("new"), "t", "value", gap.cast("long").alias("gap")).withColumnRenamed("new", "idx").select("rec_id", "idx", "t", "value", "gap")


def nearest_sample(samples: DataFrame, times: DataFrame) -> DataFrame:
    """The sample nearest to each (rec_id, at), the earlier of two.

    As-of: times and samples are merged in order and each time looks at the last sample before and the first one after.
    """
    marked = samples.select("rec_id", "t", "idx", F.lit(None).cast("double").alias("at")).unionByName(times.select("rec_id", F.col("at").alias("t"), F.lit(None).cast("long").alias("idx"), "at"))
    order = W.partitionBy("rec_id").orderBy("t", F.col("at").asc_nulls_first(), "idx")
    here = F.when(F.col("idx").isNotNull(), F.struct("t", "idx"))
    before = F.last(here, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    first_of = samples.groupBy("rec_id", "t").agg(F.min("idx").alias("least"))
    found = marked.withColumn("b", before).withColumn("a", after).where(F.col("at").isNotNull())
    take_after = F.col("b").isNull() | (F.col("a").isNotNull() & (F.col("a.t") - F.col("at") < F.col("at") - F.col("b.t")))
    near = found.select("rec_id", "at", F.when(take_after, F.col("a.t")).otherwise(F.col("b.t")).alias("t"))
    return near.join(first_of, ["rec_id", "t"]).select("rec_id", "at", F.col("least").alias("idx"))


def running_extremes(samples: DataFrame, half: int) -> DataFrame:
    frame = by_time().rowsBetween(-half, half)
    return samples.select("rec_id", "idx", F.min("value").over(frame).alias("low"), F.max("value").over(frame).alias("high"))


def running_std(samples: DataFrame, half: int, compat: bool = False) -> DataFrame:
    """Standard deviation of the population within ``half`` samples.

    With ``compat`` deviations are taken from each sample's own running mean and the first and last ``half`` samples are 0,
    as in older tools.
    """
    frame = by_time().rowsBetween(-half, half)
    if not compat:
        return samples.select("rec_id", "idx", F.stddev_pop("value").over(frame).alias("std"))
    n = F.count(F.lit(1)).over(W.partitionBy("rec_id"))
    inner = (F.col("idx") >= half) & (F.col("idx") < F.col("n") - half)
    own = samples.withColumn("n", n).withColumn("mean", F.when(inner, F.avg("value").over(frame)).otherwise(0.0))
    squared = own.withColumn("sq", F.pow(F.col("value") - F.col("mean"), 2))
    return squared.select("rec_id", "idx", F.when(inner, F.sqrt(F.avg("sq").over(frame))).otherwise(0.0).alias("std"))


def local_variance(samples: DataFrame, width: int) -> DataFrame:
    """The smaller of the variances of the next and the previous ``width`` samples; null where either is cut off."""
    after, before = by_time().rowsBetween(0, width - 1), by_time().rowsBetween(-width, -1)
    full = lambda frame: F.count(F.lit(1)).over(frame) == width
    both = F.least(F.var_pop("value").over(after), F.var_pop("value").over(before))
    return samples.select("rec_id", "idx", F.when(full(after) & full(before), both).alias("variance"))


def peaks_valleys(samples: DataFrame) -> DataFrame:
    """Samples where the slope strictly changes its sign: kind is 'peak' or 'valley'."""
    left, right = F.col("value") - F.lag("value").over(by_time()), F.lead("value").over(by_time()) - F.col("value")
    kind = F.when((left > 0) & (right < 0), "peak").when((left < 0) & (right > 0), "valley")
    return samples.select("rec_id", "idx", "value", kind.alias("kind")).where(F.col("kind").isNotNull())


def group_runs(rows: DataFrame) -> DataFrame:
    """Runs of consecutive idx: rec_id, first, last."""
    island = F.col("idx") - F.row_number().over(by_time())
    return rows.select("rec_id", "idx", island.alias("island")).groupBy("rec_id", "island").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("island")


def delay_embed(samples: DataFrame, dims: int, lag: int) -> DataFrame:
    """Points of ``dims`` coordinates, each ``lag`` samples after the one before; only whole points."""
    coords = [F.lead("value", k * lag).over(by_time()) for k in range(dims)]
    out = samples.select("rec_id", "idx", F.array(*coords).alias("point"))
    return out.where(F.get("point", F.lit(dims - 1)).isNotNull())


def minmax_norm(samples: DataFrame) -> DataFrame:
    """Values from 0 to 1 within each recording; null where all are equal."""
    w = W.partitionBy("rec_id")
    low, span = F.min("value").over(w), F.max("value").over(w) - F.min("value").over(w)
    return samples.select("rec_id", "idx", F.when(span > 0, (F.col("value") - low) / span).alias("value"))


def median_filter(samples: DataFrame, size: int) -> DataFrame:
    """Median of ``size`` (odd) samples around each, with zeros beyond the ends."""
    half = size // 2
    window = F.collect_list("value").over(by_time().rowsBetween(-half, half))
    padded = F.concat("window", F.array_repeat(F.lit(0.0), F.lit(size) - F.size("window")))
    return samples.withColumn("window", window).select("rec_id", "idx", F.get(F.array_sort(padded), F.lit(half)).alias("value"))


def fill_gaps(samples: DataFrame, silence: float, longest: int) -> DataFrame:
    """Runs of at most ``longest`` samples at or below ``silence`` become straight lines between their neighbours.

    Runs at either end stay.
    """
    voiced = F.when(F.col("value") > silence, F.struct("idx", "value"))
    left = F.last(voiced, ignorenulls=True).over(by_time().rowsBetween(W.unboundedPreceding, 0))
    right = F.first(voiced, ignorenulls=True).over(by_time().rowsBetween(0, W.unboundedFollowing))
    marked = samples.withColumn("l", left).withColumn("r", right)
    line = F.col("l.value") + (F.col("r.value") - F.col("l.value")) * (F.col("idx") - F.col("l.idx")) / (F.col("r.idx") - F.col("l.idx"))
    short = (F.col("value") <= silence) & F.col("l").isNotNull() & F.col("r").isNotNull() & (F.col("r.idx") - F.col("l.idx") - 1 <= longest)
    return marked.select("rec_id", "idx", F.when(short, line).otherwise(F.col("value")).alias("value"))


def phrases(samples: DataFrame, pause: float) -> DataFrame:
    """Stretches between pauses longer than ``pause`` seconds: rec_id, phrase, s_time, e_time, n."""
    fresh = F.when(F.col("t") - F.lag("t").over(by_time()) <= pause, 0).otherwise(1)
    numbered = samples.withColumn("fresh", fresh).withColumn("phrase", F.sum("fresh").over(by_time().rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("rec_id", "phrase").agg(F.min("t").alias("s_time"), F.max("t").alias("e_time"), F.count(F.lit(1)).alias("n"))


def breath_phrases(samples: DataFrame, silence: float, half: int) -> DataFrame:
    """Runs of voiced samples after a majority vote over ``2 * half + 1`` samples: rec_id, first, last."""
    voiced = F.avg(F.when(F.col("value") > silence, 1.0).otherwise(0.0)).over(by_time().rowsBetween(-half, half)) > 0.5
    return group_runs(samples.withColumn("voiced", voiced).where("voiced"))


def note_runs(levels: DataFrame, least: int) -> DataFrame:
    """Runs of equal levels at least ``least`` samples long: rec_id, level, first, last. Null levels end a run."""
    change = F.when(F.col("level").eqNullSafe(F.lag("level").over(by_time())), 0).otherwise(1)
    numbered = levels.withColumn("change", change).withColumn("run", F.sum("change").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.where(F.col("level").isNotNull()).groupBy("rec_id", "run").agg(F.first("level").alias("level"), F.min("idx").alias("first"), F.max("idx").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= least).select("rec_id", "level", "first", "last")
