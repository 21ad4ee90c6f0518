"""Streams: phrases, histograms and pattern search over arriving samples. A finished stream equals the batch result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import warping
from ..functions.warping import Warp


def session_phrases(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Phrases of a stream (rec_id, time, value): sessions between pauses of ``gap``, closed once nothing later can join."""
    return events.withWatermark("time", late).groupBy("rec_id", F.session_window("time", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top")).select("rec_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "top")


def stream_histogram(events: DataFrame, window: str, late: str, width: float) -> DataFrame:
    """Counts of values in bins of ``width`` for each time window."""
    bins = F.floor(F.col("value") / F.lit(width)).cast("int")
    counted = events.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "bin", "n")


def stream_search(events: DataFrame, queries: list[list[float]], threshold: float, warp: Warp) -> DataFrame:
    """Windows of each recording within ``threshold`` of a query pattern: rec_id, end, query, dist.

    State is the last samples of a recording, one less than the longest query. A batch's samples are sorted by time; those
    that come in a later batch than their successors are searched where they arrive.
    """
    patterns = [np.array(q, float) for q in queries]
    keep = max(len(q) for q in patterns) - 1

    def search(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("time", kind="stable")
        before = np.array(state.get[0], float) if state.exists else np.zeros(0)
        values, times = np.r_[before, rows["value"].to_numpy(float)], rows["time"].to_numpy()
        found = []
        for n, q in enumerate(patterns):
            if len(values) >= len(q):
                windows = np.lib.stride_tricks.sliding_window_view(values, len(q))
                ends = np.arange(len(q) - 1, len(values)) - len(before)
                fresh = ends >= 0
                dist = warping.distances(np.repeat(q[None], fresh.sum(), axis=0), np.ascontiguousarray(windows[fresh]), warp)
                found += [(key[0], times[e], n, d) for e, d in zip(ends[fresh], dist, strict=True) if d < threshold]
        state.update((values[len(values) - min(keep, len(values)) :].tolist(),))
        yield pd.DataFrame(found, columns=["rec_id", "end", "query", "dist"])

    return events.groupBy("rec_id").applyInPandasWithState(search, "rec_id long, end timestamp, query int, dist double", "last array<double>", "append", GroupStateTimeout.NoTimeout)
