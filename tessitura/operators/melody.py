"""Operators that walk through one recording at a time: cleaning, segmentation, transcription.

Their rules carry state from sample to sample, so a recording is one group; recordings are dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .series import by_time, group_runs

SAMPLES = "rec_id long, idx long, t double, value double"


def _each(samples: DataFrame, work: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``work`` of times and values of every recording; it returns columns."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("idx").to_numpy(), kind="stable")
        t, v = (rows.column(c).to_numpy(zero_copy_only=False)[order] for c in ("t", "value"))
        out = work(t, v)
        n = len(next(iter(out.values())))
        return pa.table({"rec_id": pa.array([rows.column("rec_id")[0].as_py()] * n, pa.int64()), **{k: pa.array(x) for k, x in out.items()}})

    rows = samples.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("idx").cast("long").alias("idx"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("rec_id").applyInArrow(run, schema)


def _numbered(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    return {"idx": np.arange(len(v), dtype=np.int64), "t": t.astype(float), "value": v.astype(float)}


def resample(samples: DataFrame, hop: float, silence: float = 0.0) -> DataFrame:
    """Values on a clock of ``hop`` seconds by straight lines; silent where either neighbour is."""

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        clock = t[0] + hop * np.arange(int(np.floor((t[-1] - t[0]) / hop + 1e-9)) + 1)
        right = np.clip(np.searchsorted(t, clock), 0, len(t) - 1)
        left = np.where(t[right] == clock, right, np.maximum(right - 1, 0))
        quiet = (v[left] <= silence) | (v[right] <= silence)
        return _numbered(clock, np.where(quiet, 0.0, np.interp(clock, t, v)))

    return _each(samples, work, SAMPLES)


def octave_error_fix(samples: DataFrame) -> DataFrame:
    """Values two, three or four times the one before (within 0.1) are divided by that; those near a half are doubled."""

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        out = v.astype(float).copy()
        for i in range(1, len(v)):
            if out[i - 1] > 0:
                ratio = v[i] / out[i - 1]
                for k in (2, 3, 4):
                    if abs(ratio - k) < 0.1:
                        out[i] = v[i] / k
                if abs(ratio - 0.5) < 0.05:
                    out[i] = v[i] * 2
        return _numbered(t, out)

    return _each(samples, work, SAMPLES)


def gaussian_smooth(samples: DataFrame, sigma: float, silence: float = 0.0) -> DataFrame:
    """A Gaussian run forth and back over each voiced stretch, so nothing is shifted; silence stays."""

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        half = max(1, round(3 * sigma))
        kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
        kernel /= kernel.sum()
        out = v.astype(float).copy()
        voiced = np.flatnonzero(v > silence)
        for run in np.split(voiced, np.flatnonzero(np.diff(voiced) > 1) + 1):
            if len(run):
                padded = np.pad(out[run], 2 * half, mode="edge")
                out[run] = np.convolve(np.convolve(padded, kernel, "same"), kernel, "same")[2 * half : 2 * half + len(run)]
        return _numbered(t, out)

    return _each(samples, work, SAMPLES)


def jump_fix(samples: DataFrame, silence: float = 0.0, cents: float = 600.0, longest: int = 20) -> DataFrame:
    """Stretches of at most ``longest`` samples between a jump and its reverse are shifted by the jump, in whole semitones;
    a single such sample becomes the mean of its neighbours. Jumps are steps of more than ``cents`` between voiced samples.
    """

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        out = v.astype(float).copy()
        voiced = out > silence
        level = np.where(voiced, 1200 * np.log2(np.where(voiced, out, 1.0)), np.nan)
        i = 1
        while i < len(level):
            step = level[i] - level[i - 1]
            if abs(step) > cents:
                for j in range(i + 1, min(i + 1 + longest, len(level))):
                    back = level[j] - level[j - 1]
                    if np.isnan(back):
                        break
                    if abs(back) > cents:
                        if back * step < 0:
                            if j == i + 1:
                                level[i] = (level[i - 1] + level[j]) / 2
                            else:
                                level[i:j] -= np.round(step / 100) * 100
                        break
            i += 1
        return _numbered(t, np.where(voiced, 2 ** (np.nan_to_num(level) / 1200), out))

    return _each(samples, work, SAMPLES)


def transcribe(levels: DataFrame, shortest: int, longest_gap: int = 120) -> DataFrame:
    """Notes of quantised levels (rec_id, idx, t, value; null is no note): rec_id, s_time, e_time, level.

    A run shorter than ``shortest`` samples is absorbed by the next one; then neighbours of one level with at most
    ``longest_gap`` samples between them are merged.
    """

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        key = np.where(np.isnan(v), np.inf, v)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
        runs = [[int(a), int(b), float(key[a])] for a, b in zip(first, np.r_[first[1:], len(key)], strict=True)]
        kept: list[list] = []
        start = None
        for k, (a, b, level) in enumerate(runs):
            a = a if start is None else start
            start = None
            if b - a < shortest and k + 1 < len(runs):
                start = a
            elif b - a >= shortest and np.isfinite(level):
                kept.append([a, b, level])
        merged: list[list] = []
        for a, b, level in kept:
            if merged and merged[-1][2] == level and a - merged[-1][1] <= longest_gap:
                merged[-1][1] = b
            else:
                merged.append([a, b, level])
        a, b, level = (np.array([m[k] for m in merged]) for k in range(3))
        a, b = a.astype(int), b.astype(int)
        return {"s_time": t[a].astype(float), "e_time": t[b - 1].astype(float), "level": level.astype(float)}

    return _each(levels, work, "rec_id long, s_time double, e_time double, level double")


def piecewise_linear(samples: DataFrame, tolerance: float) -> DataFrame:
    """Breakpoints of a line of chords: neighbouring pieces with the least mean error are merged while it is below
    ``tolerance``. Returns rec_id, first, last, error."""

    def work(t: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
        def error(a: int, b: int) -> float:
            return float(np.abs(v[a : b + 1] - np.linspace(v[a], v[b], b - a + 1)).mean())

        points = list(range(0, len(v), 1)) if len(v) else []
        costs = [error(points[i - 1], points[i + 1]) for i in range(1, len(points) - 1)]
        while costs:
            k = int(np.argmin(costs))
            if costs[k] >= tolerance:
                break
            del points[k + 1], costs[k]
            for i in (k - 1, k):
                if 0 <= i < len(costs):
                    costs[i] = error(points[i], points[i + 2])
        first, last = np.array(points[:-1], np.int64), np.array(points[1:], np.int64)
        return {"first": first, "last": last, "error": np.array([error(a, b) for a, b in zip(first, last, strict=True)], float)}

    return _each(samples, work, "rec_id long, first long, last long, error double")


def flat_variance(variances: DataFrame, threshold: float) -> DataFrame:
    """Runs of samples with a local variance of at most ``threshold``: rec_id, first, last."""
    return group_runs(variances.where(F.col("variance") <= threshold))


def flat_vicinity(samples: DataFrame, pitches: DataFrame, tolerance: float, bucket: float = 100.0) -> DataFrame:
    """Runs of samples within ``tolerance`` of a stable pitch (rec_id, pitch) of their recording."""
    cell = F.floor(F.col("value") / bucket)
    near = pitches.select(F.col("rec_id").alias("p_rec"), "pitch", F.explode(F.sequence(F.floor((F.col("pitch") - tolerance) / bucket), F.floor((F.col("pitch") + tolerance) / bucket))).alias("p_cell"))
    hit = samples.join(near, (F.col("rec_id") == F.col("p_rec")) & (cell == F.col("p_cell")) & (F.abs(F.col("value") - F.col("pitch")) < tolerance), "left_semi")
    return group_runs(hit)


def note_candidates(samples: DataFrame, pitches: Sequence[float], tolerance: float, shortest: int, bridge: int) -> DataFrame:
    """Stays within ``tolerance`` of each pitch, with breaks of up to ``bridge`` samples, at least ``shortest`` samples
    long: rec_id, pitch, first, last."""
    near = samples.select("*", F.explode(F.array(*[F.lit(float(p)) for p in pitches])).alias("pitch")).where(F.abs(F.col("value") - F.col("pitch")) <= tolerance)
    w = W.partitionBy("rec_id", "pitch").orderBy("idx")
    fresh = F.when(F.col("idx") - F.lag("idx").over(w) - 1 <= bridge, 0).otherwise(1)
    runs = near.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = runs.groupBy("rec_id", "pitch", "run").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))
    return out.where(F.col("last") - F.col("first") + 1 >= shortest).select("rec_id", "pitch", "first", "last")


def keep_longest(segments: DataFrame) -> DataFrame:
    """At every sample the longest of the segments (rec_id, first, last) over it: rec_id, first, last of what each keeps.

    Segments are walked by their ends, not by samples: between two ends the longest one over them is the same.
    """
    edges = segments.select("rec_id", F.explode(F.array("first", F.col("last") + 1)).alias("lo")).distinct()
    pieces = edges.withColumn("hi", F.lead("lo").over(W.partitionBy("rec_id").orderBy("lo")) - 1).where(F.col("hi").isNotNull())
    s = segments.select(F.col("rec_id").alias("s_rec"), F.col("first").alias("sf"), F.col("last").alias("sl"))
    over = pieces.join(s, (F.col("rec_id") == F.col("s_rec")) & (F.col("sf") <= F.col("lo")) & (F.col("sl") >= F.col("hi")))
    best = over.groupBy("rec_id", "lo", "hi").agg(F.max_by(F.struct("sf", "sl"), F.struct(F.col("sl") - F.col("sf"), -F.col("sf"))).alias("o"))
    w = W.partitionBy("rec_id").orderBy("lo")
    fresh = F.when((F.col("o") == F.lag("o").over(w)) & (F.lag("hi").over(w) + 1 == F.col("lo")), 0).otherwise(1)
    runs = best.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("rec_id", "run").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).drop("run")


def section_runs(frames: DataFrame, half: int) -> DataFrame:
    """Runs of equal class after a majority vote over ``2 * half + 1`` frames (rec_id, idx, label): rec_id, label, first, last."""
    window = F.collect_list("label").over(by_time().rowsBetween(-half, half))
    counted = F.transform(F.array_distinct("w"), lambda c: F.struct(F.size(F.filter("w", lambda x: x == c)).alias("n"), (-c).alias("c")))
    voted = frames.withColumn("w", window).withColumn("label", -F.array_max(counted)["c"])
    change = F.when(F.col("label") == F.lag("label").over(by_time()), 0).otherwise(1)
    runs = voted.withColumn("change", change).withColumn("run", F.sum("change").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("rec_id", "run", "label").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).drop("run")
