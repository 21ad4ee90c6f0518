"""Scalar expressions on the samples of a series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to a frequency before its logarithm is taken.
EPSILON = 1e-16


def hz_to_cents(hz: Column, tonic: Column, bins_per_octave: int = 1200) -> Column:
    """Bins above the tonic; null for a tonic that isn't positive."""
    return F.when(tonic > 0, F.log2((hz + F.lit(EPSILON)) / tonic) * F.lit(float(bins_per_octave)))


def cents_to_hz(cents: Column, tonic: Column) -> Column:
    return tonic * F.pow(F.lit(2.0), cents / F.lit(1200.0))


def octave_fold(cents: Column, octave: float = 1200.0) -> Column:
    """Within one octave, never negative."""
    return cents - F.floor(cents / F.lit(octave)) * F.lit(octave)


def quantize_pitch(cents: Column, bins_per_octave: int, steps: int) -> Column:
    """The nearest of ``steps`` equal steps an octave; a step is a whole number of bins."""
    step = float(bins_per_octave // steps)
    return F.floor(cents / F.lit(step) + F.lit(0.5)) * F.lit(step)


def quantize_level(cents: Column, width: float = 35.0, ignore: Sequence[int] = (), low: int = -800, high: int = 2500) -> Column:
    """The semitone level within ``width`` cents (the lower of two), or null; levels in ``ignore`` don't count."""
    levels = [n for n in range(low, high, 100) if n not in set(ignore)]
    near = F.filter(F.array(*[F.lit(n) for n in levels]), lambda n: F.abs(cents - n) <= F.lit(width))
    return F.get(near, F.lit(0))


def seconds_to_hms(seconds: Column) -> Column:
    """H:M:S without padding, in whole seconds."""
    s = F.floor(seconds).cast("long")
    return F.concat_ws(":", F.floor(s / 3600).cast("long").cast("string"), (F.floor(s / 60).cast("long") % 60).cast("string"), (s % 60).cast("string"))


def strip_prefix(path: Column, *prefixes: str) -> Column:
    """The path without the first of the prefixes that it starts with."""
    out = F.lit(None)
    for prefix in prefixes:
        out = F.coalesce(out, F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))))
    return F.coalesce(out, path)


def point_distance(a: Column, b: Column, kind: str = "sq_euclidean") -> Column:
    """Distance of two values: euclidean and city_block are |a - b|, tmm folds |a - b| at a period of 53."""
    d = F.abs(a - b)
    kinds = {"euclidean": d, "city_block": d, "sq_euclidean": d * d, "tmm": F.least(d % F.lit(53.0), F.lit(53.0) - d % F.lit(53.0))}
    if kind not in kinds:
        raise ValueError(f"unknown distance {kind}")
    return kinds[kind]
