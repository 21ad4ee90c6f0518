"""Fixed-length subsequences of series, their filters and their scaled copies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import arrays
from .series import by_time

#: Which pairs of time scales are compared, of three and of five.
SCALE_PAIRS = {
    1: ((0, 0),),
    3: ((0, 2), (1, 1), (1, 2), (2, 0), (2, 1)),
    5: ((0, 4), (1, 4), (2, 2), (2, 3), (2, 4), (3, 2), (4, 0), (4, 1), (4, 2)),
}
SCALES = {1: (1.0,), 3: (0.9, 1.0, 1.1), 5: (0.9, 0.95, 1.0, 1.05, 1.1)}


def motif_lengths(duration: float, hop: float, factors: Sequence[float]) -> tuple[int, list[int]]:
    """Samples of the real length, and of each factor's; the longest gets one more if there are several."""
    lengths = [math.ceil(duration * f / hop) for f in factors]
    if len(factors) > 1:
        lengths[max(range(len(lengths)), key=lambda i: factors[i])] += 1
    return math.ceil(duration / hop), lengths


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two intervals share more than an end."""
    return (e1 - s2) * (e2 - s1) > 0


def scale_allowed(a: Column, b: Column, scales: int) -> Column:
    """Whether two scale indices are compared."""
    if scales not in SCALE_PAIRS:
        raise ValueError("one, three or five scales")
    return (a * scales + b).isin([x * scales + y for x, y in SCALE_PAIRS[scales]])


def sliding_windows(samples: DataFrame, length: int, real: int | None = None, *carry: str, with_times: bool = False) -> DataFrame:
    """Every window of ``length`` samples: rec_id, sub_id, s_time, e_time (of sample ``real``), data and carried columns.

    ``with_times`` adds the samples' times, which scaled copies need to know where they end.
    """
    frame = by_time().rowsBetween(0, length - 1)
    end = F.last("t").over(by_time().rowsBetween(0, (real or length) - 1))
    more = [F.collect_list("t").over(frame).alias("times")] if with_times else []
    out = samples.select("rec_id", F.col("idx").alias("sub_id"), F.col("t").alias("s_time"), end.alias("e_time"), F.collect_list("value").over(frame).alias("data"), *more, *carry)
    return out.where(F.size("data") == length)


def windows_at(samples: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Windows that begin at given sample indices (rec_id, idx); starts too near the end give none."""
    return sliding_windows(samples, length).join(starts.select("rec_id", F.col("idx").alias("sub_id")).distinct(), ["rec_id", "sub_id"], "left_semi")


def uniform_scale(windows: DataFrame, length: int, factors: Sequence[float], lengths: Sequence[int] | None = None) -> DataFrame:
    """A copy of each window for each factor, all of ``length`` samples, by cubic interpolation; scale_idx names the factor.

    If windows carry times and ``lengths`` (samples of each factor) is given, e_time is that of the copy's last sample.
    """
    scale = F.posexplode(F.array(*[F.lit(float(f)) for f in factors])).alias("scale_idx", "factor")
    spread = windows.select("*", scale)
    if lengths is not None:
        spread = spread.withColumn("e_time", F.get("times", F.get(F.array(*[F.lit(n - 1) for n in lengths]), F.col("scale_idx")))).drop("times")
    data = arrays.interpolate(F.col("data"), arrays.scaled_positions(length, F.col("factor")), "cubic")
    return spread.withColumn("data", data).withColumn("sub_id", F.col("sub_id") * len(factors) + F.col("scale_idx")).drop("factor")


def with_stats(windows: DataFrame, real: int | None = None) -> DataFrame:
    """Mean and standard deviation (population) of the first ``real`` samples."""
    part = F.col("data") if real is None else F.slice("data", 1, real)
    return windows.withColumn("mean", arrays.mean(part)).withColumn("std", arrays.std(part))


def paused(samples: DataFrame, length: int, hop: float, longest: float) -> DataFrame:
    """Which windows hold more than ``longest`` seconds of dropped samples after their first sample: rec_id, sub_id, drop."""
    gaps = F.coalesce(F.sum("gap").over(by_time().rowsBetween(1, length - 1)), F.lit(0))
    full = F.count(F.lit(1)).over(by_time().rowsBetween(0, length - 1)) == length
    return samples.select("rec_id", F.col("idx").alias("sub_id"), (gaps * F.lit(hop) > F.lit(longest)).alias("drop"), full.alias("full")).where("full").drop("full")


def flat(stds: DataFrame, length: int, threshold: float, share: float) -> DataFrame:
    """Which windows have too few lively samples (std above ``threshold``): rec_id, sub_id, drop."""
    lively = F.sum(F.when(F.col("std") > threshold, 1).otherwise(0)).over(by_time().rowsBetween(0, length - 1))
    full = F.count(F.lit(1)).over(by_time().rowsBetween(0, length - 1)) == length
    return stds.select("rec_id", F.col("idx").alias("sub_id"), (lively < F.lit(share * length)).alias("drop"), full.alias("full")).where("full").drop("full")


def outside_segments(windows: DataFrame, segments: DataFrame, bucket: float = 60.0) -> DataFrame:
    """Windows that touch none of the segments (rec_id, seg_start, seg_end), ends included.

    Both sides fall into time buckets, so a recording with very many segments is an equi join, not a product.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor(b / bucket)))
    s = segments.select(F.col("rec_id").alias("seg_rec"), "seg_start", "seg_end", cells(F.col("seg_start"), F.col("seg_end")).alias("seg_cell"))
    w = windows.select("rec_id", "sub_id", "s_time", "e_time", cells(F.col("s_time"), F.col("e_time")).alias("cell"))
    hit = w.join(s, (F.col("rec_id") == F.col("seg_rec")) & (F.col("cell") == F.col("seg_cell")) & (F.col("e_time") >= F.col("seg_start")) & (F.col("s_time") <= F.col("seg_end")), "left_semi")
    return windows.join(hit.select("rec_id", "sub_id").distinct(), ["rec_id", "sub_id"], "left_anti")


def presence(samples: DataFrame, segments: DataFrame, lowest: float) -> DataFrame:
    """Share of voiced samples of each segment (rec_id, seg_start, seg_end)."""
    inside = (samples["rec_id"] == segments["rec_id"]) & samples["t"].between(segments["seg_start"], segments["seg_end"])
    joined = segments.join(samples, inside)
    return joined.groupBy(segments["rec_id"], "seg_start", "seg_end").agg(F.avg(F.when(F.col("value") > lowest, 1.0).otherwise(0.0)).alias("voiced"))


def numbered(windows: DataFrame) -> DataFrame:
    """sub_id counted anew within each recording."""
    order = W.partitionBy("rec_id").orderBy("sub_id")
    return windows.withColumn("sub_id", (F.row_number().over(order) - 1).cast("long"))


def near(s1: Column, s2: Column, least: float) -> Column:
    """Whether two subsequences start less than ``least`` apart."""
    return F.abs(s1 - s2) < least


def flat_range(data: Column, least: float = 300.0, lowest: float = -1200.0) -> Column:
    """Whether a subsequence spans less than ``least`` or goes below ``lowest``."""
    return (F.array_max(data) - F.array_min(data) < least) | (F.array_min(data) < lowest)


def thinned(data: Column, step: int) -> Column:
    """Every ``step``-th sample of a subsequence, from the first on."""
    return F.filter(data, lambda _, i: i % step == 0)


def flat_windows(samples: DataFrame, length: int, share: float) -> DataFrame:
    """rec_id and sub_id of windows with at least ``share`` of their samples marked (column flat)."""
    frame = by_time().rowsBetween(0, length - 1)
    marked = samples.select("rec_id", F.col("idx").alias("sub_id"), F.sum(F.col("flat").cast("int")).over(frame).alias("n"), F.count(F.lit(1)).over(frame).alias("size"))
    return marked.where((F.col("size") == length) & (F.col("n") >= share * length)).select("rec_id", "sub_id")


def without_listed(windows: DataFrame, listed: DataFrame) -> DataFrame:
    """Windows that a list of rec_id and sub_id doesn't name."""
    return windows.join(listed.select("rec_id", "sub_id").distinct(), ["rec_id", "sub_id"], "left_anti")


def windows_in_phrases(samples: DataFrame, length: int, hop: int = 3) -> DataFrame:
    """Windows that lie in one phrase (column phrase), from its start on every ``hop`` samples: rec_id, phrase, sub_id, data."""
    inside = W.partitionBy("rec_id", "phrase").orderBy("idx")
    at = (F.row_number().over(inside) - 1) % hop
    found = samples.select("rec_id", "phrase", F.col("idx").alias("sub_id"), at.alias("at"), F.collect_list("value").over(inside.rowsBetween(0, length - 1)).alias("data"))
    return found.where((F.col("at") == 0) & (F.size("data") == length)).drop("at")
