"""Expressions on whole sequences (ARRAY<DOUBLE>): everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .samples import point_distance

EPS = 1e-16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row; a lambda would compute what it closes over for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def mean(x: Column) -> Column:
    """Null for an empty sequence."""
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def variance(x: Column) -> Column:
    """Of the population."""
    return F.when(F.size(x) > 0, let(mean(x), lambda m: F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(x)))


def std(x: Column) -> Column:
    return F.sqrt(variance(x))


def median(x: Column) -> Column:
    """The middle value, or the mean of the two in the middle."""
    n = F.size(x)
    return let(F.sort_array(x), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def median_compat(x: Column) -> Column:
    """The element below the middle, cut to a whole number: what older tools call the median of a sequence."""
    s, n = F.sort_array(x), F.size(x)
    return F.get(s, F.greatest(F.floor(n / 2).cast("int") - 1, F.lit(0))).cast("long").cast("double")  # a long has no -0


def mad(x: Column) -> Column:
    """Median absolute deviation."""
    return let(let(median(x), lambda m: F.transform(x, lambda v: F.abs(v - m))), median)


def normalize(x: Column, kind: str, tonic: Column | None = None, semitone: float = 100.0) -> Column:
    """none, tonic (given), z, mean, median, mad, qmedian (median rounded to semitones)."""
    zero = lambda d: let(d, lambda v: F.when(v == 0, F.lit(1.0)).otherwise(v))
    if kind == "none":
        return x
    if kind == "tonic":
        if tonic is None:
            raise ValueError("tonic normalisation needs the tonic")
        return F.transform(x, lambda v: v - tonic)
    shift, scale = {
        "z": (mean(x), zero(std(x))),
        "mean": (mean(x), F.lit(1.0)),
        "median": (median(x), F.lit(1.0)),
        "mad": (median(x), zero(mad(x))),
        "qmedian": (F.floor(median(x) / F.lit(semitone) + F.lit(0.5)) * F.lit(semitone), F.lit(1.0)),
    }[kind]
    return let(F.struct(shift.alias("shift"), scale.alias("scale")), lambda s: F.transform(x, lambda v: (v - s["shift"]) / s["scale"]))


def octave_offset(mean_a: Column, mean_b: Column, octave: float = 1200.0) -> Column:
    """The whole octaves between two sequences, if their distance is within an eighth octave of them; else 0."""
    d = mean_a - mean_b
    r = F.round(d / F.lit(octave)) * F.lit(octave)
    return F.when(F.abs(d - r) <= F.lit(octave / 8), r).otherwise(F.lit(0.0))


def fifth_offset(mean_a: Column, mean_b: Column) -> Column:
    """A fifth, an octave or an octave and a fifth between two sequences (700, 1200, 1900 cents), signed; else 0."""
    d = mean_a - mean_b
    size = F.abs(d)
    step = F.when((size > 550) & (size < 850), 700.0).when((size > 1050) & (size < 1350), 1200.0).when((size > 1750) & (size < 2050), 1900.0).otherwise(0.0)
    return F.signum(d) * step


def _pairs(x: Column, lag: int = 1) -> Column:
    """Differences of neighbours."""
    n = F.size(x)
    return F.when(n > lag, F.transform(F.sequence(F.lit(lag), n - 1), lambda i: F.get(x, i) - F.get(x, i - lag))).otherwise(F.array().cast("array<double>"))


def complexity_1(x: Column, limit: float = 600.0) -> Column:
    """Root mean square of the first differences of at most ``limit``; EPS if there is none."""
    return let(F.filter(_pairs(x), lambda v: F.abs(v) <= F.lit(limit)), _root_mean_square)


def _root_mean_square(d: Column) -> Column:
    return F.when(F.size(d) > 0, F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v * v) / F.size(d))).otherwise(F.lit(EPS))


def complexity_2(x: Column, limit: float = 600.0) -> Column:
    """Root mean square of the changes of the size of first differences."""
    sizes = F.transform(_pairs(x), F.abs)
    return let(F.filter(F.transform(let(sizes, lambda d: _pairs(d)), F.abs), lambda v: v <= F.lit(limit)), _root_mean_square)


def inflections_1(x: Column) -> Column:
    """One more than the changes of the slope's sign; flat steps have no sign."""
    changes = lambda s: F.when(F.size(s) > 1, F.size(F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i) != F.get(s, i - 1)))).otherwise(F.lit(0))
    return F.lit(1) + let(F.filter(F.transform(_pairs(x), F.signum), lambda v: v != 0), changes)


def inflections_2(x: Column, least: float = 50.0) -> Column:
    """As inflections_1, but after the first a change counts only if the value moved by more than ``least`` since the last one."""
    n = F.size(x)
    start = F.struct(F.lit(0.0).alias("sign"), F.lit(1).alias("n"), F.lit(None).cast("double").alias("saddle"))

    def step(s: Column, i: Column) -> Column:
        slope = F.signum(F.get(x, i) - F.get(x, i - 1))
        change = (slope != 0) & (s["sign"] != 0) & (slope != s["sign"])
        counts = change & (s["saddle"].isNull() | (F.abs(F.get(x, i - 1) - s["saddle"]) > F.lit(least)))
        return F.struct(
            F.when(slope != 0, slope).otherwise(s["sign"]).alias("sign"),
            (s["n"] + F.when(counts, 1).otherwise(0)).alias("n"),
            F.when(change, F.get(x, i - 1)).otherwise(s["saddle"]).alias("saddle"),
        )

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["n"])).otherwise(F.lit(1))


def linear_stretch(x: Column, length: int) -> Column:
    """``length`` samples, each the source's at ``floor(i * n / length)``."""
    n = F.size(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.get(x, F.floor(i * n / F.lit(length)).cast("int"))))


def interpolate(x: Column, positions: Column, kind: str = "linear") -> Column:
    """Values at fractional positions, by polynomials through 2 (linear), 3 (quadratic: the one before and two after) or 4
    neighbours (cubic: two on either side). No neighbour lies before the start, after the end, or, where it is the second
    one after, beyond the last position rounded up."""
    reach = {"linear": (0, 1), "quadratic": (0, 1, 2), "cubic": (-1, 0, 1, 2)}[kind]

    def around(p: Column, last: Column) -> Column:
        """The neighbours of a position, taken once, and how far it lies beyond the one before it."""

        def at(k: Column, o: int) -> Column:
            i = F.least(k + o, F.size(x) - 1)
            return F.get(x, F.greatest(F.least(i, last) if o == 2 else i, F.lit(0)))

        return let(F.floor(p).cast("int"), lambda k: F.struct((p - k).alias("f"), *[at(k, o).alias(f"v{o + 1}") for o in reach]))

    def value(n: Column) -> Column:
        f = n["f"]
        if kind == "linear":
            return n["v1"] * (F.lit(1.0) - f) + n["v2"] * f
        if kind == "quadratic":
            return n["v1"] * (f - 1.0) * (f - 2.0) / 2.0 - n["v2"] * f * (f - 2.0) + n["v3"] * f * (f - 1.0) / 2.0
        outer = (n["v3"] * (f + 1.0) - n["v0"] * (f - 2.0)) * f * (f - 1.0) / 6.0
        return outer + (n["v1"] * (f - 1.0) - n["v2"] * f) * (f + 1.0) * (f - 2.0) / 2.0

    ends = F.struct(positions.alias("p"), F.ceil(F.element_at(positions, -1)).cast("int").alias("last"))
    return let(ends, lambda e: F.transform(e["p"], lambda p: let(around(p, e["last"]), value)))


def scaled_positions(length: int, factor: Column | float) -> Column:
    """Where ``length`` samples lie in a source stretched by ``factor``."""
    factor = F.lit(float(factor)) if isinstance(factor, (int, float)) else factor
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: i * factor)


def running_extreme(x: Column, half: int, largest: bool) -> Column:
    """Largest or smallest value within ``half`` samples on either side."""
    pick = F.array_max if largest else F.array_min
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), lambda i: pick(F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(F.lit(2 * half + 1), i + half + 1))))


def autocorrelation(x: Column) -> Column:
    """Of the z-normalised sequence, made unbiased by n / (n - lag) and divided by its largest value."""
    n = F.size(x)

    def lags(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.sequence(F.lit(0), n - 1 - k), F.lit(0.0), lambda s, j: s + F.get(z, j) * F.get(z, j + k)) * n / (n - k))

    def scaled(raw: Column) -> Column:
        return let(F.array_max(raw), lambda top: F.transform(raw, lambda v: F.when(top > 0, v / top).otherwise(v)))

    return let(let(normalize(x, "z"), lags), scaled)


def sequence_distance(x: Column, y: Column, kind: str = "sq_euclidean") -> Column:
    """Sum of point distances over the shorter length."""
    n = F.least(F.size(x), F.size(y))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + point_distance(F.get(x, i), F.get(y, i), kind))).otherwise(F.lit(0.0))


def lb_kim(x: Column, y: Column, kind: str = "sq_euclidean", shift: Column | None = None) -> Column:
    """Distance of the first and of the last points: a bound below any warping distance."""
    shift = F.lit(0.0) if shift is None else shift
    return point_distance(F.get(x, F.lit(0)), F.get(y, F.lit(0)) + shift, kind) + point_distance(F.get(x, F.size(x) - 1), F.get(y, F.size(y) - 1) + shift, kind)


def lb_keogh(upper: Column, lower: Column, y: Column, kind: str = "sq_euclidean", shift: Column | None = None) -> Column:
    """Distance of a sequence to another's envelope, where it lies outside."""
    shift = F.lit(0.0) if shift is None else shift

    def outside(ends: Column, i: Column) -> Column:
        v, high, low = F.get(y, i) + shift, F.get(ends["high"], i), F.get(ends["low"], i)
        return F.when(v > high, point_distance(v, high, kind)).when(v < low, point_distance(v, low, kind)).otherwise(F.lit(0.0))

    return let(F.struct(upper.alias("high"), lower.alias("low")), lambda ends: F.aggregate(F.sequence(F.lit(0), F.size(y) - 1), F.lit(0.0), lambda s, i: s + outside(ends, i)))


def dtw(x: Column, y: Column, band: int, kind: str = "sq_euclidean") -> Column:
    """Banded warping distance as nested aggregates: one row of the cost matrix after another."""
    inf = F.lit(float("inf"))
    n, m = F.size(x), F.size(y)

    def row(previous: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            d = point_distance(F.get(x, i), F.get(y, j), kind)
            corner = F.when((i == 0) & (j == 0), F.lit(0.0)).otherwise(inf)
            best = F.least(F.coalesce(F.get(previous, j), inf), F.coalesce(F.get(previous, j - 1), inf), F.coalesce(F.get(done, j - 1), inf), inf)
            best = F.when((i == 0) & (j == 0), corner).otherwise(best)
            return F.concat(done, F.array(F.when(F.abs(i - j) <= band, d + best).otherwise(inf)))

        return F.aggregate(F.sequence(F.lit(0), m - 1), F.array().cast("array<double>"), cell)

    rows = F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<double>"), row)
    return F.get(rows, m - 1)


def peakiness(x: Column) -> Column:
    """Arithmetic over geometric mean; null unless all values are positive."""
    logs = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.when(v > 0, F.log(v)))
    return mean(x) / F.exp(logs / F.size(x))
