"""Motif discovery from samples in Hz to the best pairs: what one run over a collection of recordings does."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import samples as fs
from ..functions.warping import Warp
from ..operators import series, simjoin, subsequences


@dataclass(frozen=True)
class DiscoveryParams:
    """Durations are in seconds; ``rate_ms`` is the wanted distance of samples, ``band`` a share of the length."""

    duration: float = 2.0
    rate_ms: float = 22.5
    bins_per_octave: int = 1200
    lowest: float = 60.0
    std_seconds: float = 0.1
    std_threshold: float = 15.0
    flat_share: float = 0.8
    longest_pause: float = 0.5
    band: float = 0.1
    scales: int = 5
    pairs: int = 5

    def __post_init__(self) -> None:
        if self.scales not in subsequences.SCALES:
            raise ValueError("one, three or five scales")


def candidates(samples: DataFrame, tonics: DataFrame, segments: DataFrame | None, hop: float, p: DiscoveryParams) -> DataFrame:
    """Scaled subsequences of recordings (rec_id, idx, t, value in Hz) with one ``hop``, without those that are paused, flat
    or touch a segment. sub_id counts the windows that are left, times the number of scales, plus the scale."""
    factor = max(1, math.floor(p.rate_ms / (hop * 1000) + 0.5))
    hop = hop * factor
    voiced = series.filter_silence(series.downsample(samples, factor), p.lowest)
    cents = voiced.join(tonics.select("rec_id", "tonic"), "rec_id").withColumn("value", fs.hz_to_cents(F.col("value"), F.col("tonic"), p.bins_per_octave)).drop("tonic")
    factors = subsequences.SCALES[p.scales]
    real, lengths = subsequences.motif_lengths(p.duration, hop, factors)
    longest = max(lengths)
    windows = subsequences.sliding_windows(cents, longest, real, with_times=True)
    paused = subsequences.paused(cents, longest, hop, p.longest_pause)
    stds = series.running_std(cents, round(p.std_seconds / hop), compat=True)
    flat = subsequences.flat(stds, longest, p.std_threshold, p.flat_share)
    for rule in (paused, flat):
        windows = windows.join(rule.where("drop").select("rec_id", "sub_id"), ["rec_id", "sub_id"], "left_anti")
    if segments is not None:
        windows = subsequences.outside_segments(windows, segments)
    return subsequences.uniform_scale(subsequences.numbered(windows), real, factors, lengths)


def discover(samples: DataFrame, tonics: DataFrame, segments: DataFrame | None, hop: float, p: DiscoveryParams = DiscoveryParams(), bound: float = float("inf"), mode: str = "ref") -> DataFrame:
    """The best pairs of each recording; ``bound`` leaves all slots below it as they are (see ``motif_discovery``)."""
    found = candidates(samples, tonics, segments, hop, p)
    length = subsequences.motif_lengths(p.duration, hop * max(1, math.floor(p.rate_ms / (hop * 1000) + 0.5)), (1.0,))[0]
    return simjoin.motif_discovery(found, p.pairs, Warp(band=math.floor(length * p.band)), mode=mode, bound=bound, scales=p.scales)
