"""Queries on whole sequences: array expressions and warping distances over all embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..catalog import query
from ..functions import arrays as fa
from ..functions.warping import Warp
from ..operators import simjoin
from .base import VECTORS, vectors

R = 6


def sql(select: str, *more: str) -> str:
    return "WITH RECURSIVE " + ", ".join([VECTORS, *more]) + " " + select


#: DuckDB expressions of the same quantities, of a list x.
MEAN = "list_avg(x)"
STD = "list_stddev_pop(x)"
MEDIAN = "list_median(x)"
MAD = "list_median(list_transform(x, lambda v: abs(v - list_median(x))))"
DIFFS = "list_transform(range(2, len(x) + 1), lambda i: x[i] - x[i - 1])"


@query("sequence_stats", sql(f"SELECT vec_id, round({MEAN}, {R}) AS mean, round({STD}, {R}) AS std, round({MEDIAN}, {R}) AS median, round({MAD}, {R}) AS mad FROM vectors"))
def sequence_stats(spark, sf):
    x = F.col("x")
    return vectors(spark, sf).select("vec_id", *[F.round(f(x), R).alias(n) for n, f in (("mean", fa.mean), ("std", fa.std), ("median", fa.median), ("mad", fa.mad))])


@query("median_compat", sql("SELECT vec_id, trunc(list_sort(list_transform(x, lambda v: round(v * 100, 4)))[len(x) // 2]) + 0.0 AS median FROM vectors"))
def median_compat(spark, sf):
    return vectors(spark, sf).select("vec_id", fa.median_compat(F.transform("x", lambda v: F.round(v * 100, 4))).alias("median"))


def _norm(name: str, shift: str, scale: str = "1.0"):
    text = sql(f"SELECT vec_id, i, round((x[i] - {shift}) / {scale}, {R}) AS v FROM vectors, (SELECT unnest(range(1, 65)) AS i)")

    @query(f"norm_{name}", text)
    def run(spark, sf):
        normal = fa.normalize(F.col("x"), name, tonic=F.lit(0.25), semitone=0.125)
        return vectors(spark, sf).select("vec_id", F.posexplode(normal).alias("i", "v")).select("vec_id", (F.col("i") + 1).cast("long").alias("i"), F.round("v", R).alias("v"))

    return run


for _name, _parts in {"none": ("0",), "tonic": ("0.25",), "z": (MEAN, STD), "mean": (MEAN,), "median": (MEDIAN,), "mad": (MEDIAN, MAD), "qmedian": (f"floor({MEDIAN} / 0.125 + 0.5) * 0.125",)}.items():
    _norm(_name, *_parts)


@query("complexity", sql(f"""SELECT vec_id, round(sqrt(list_avg(list_transform(list_filter(d, lambda v: abs(v) <= 600), lambda v: v * v))), {R}) AS c1,
  round(sqrt(list_avg(list_transform(list_filter(list_transform(range(2, len(d) + 1), lambda i: abs(abs(d[i]) - abs(d[i - 1]))), lambda v: v <= 600), lambda v: v * v))), {R}) AS c2 FROM (SELECT vec_id, {DIFFS} AS d FROM vectors)"""))  # fmt: skip
def complexity(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(fa.complexity_1(F.col("x")), R).alias("c1"), F.round(fa.complexity_2(F.col("x")), R).alias("c2"))


_INFLECT = f"""SELECT vec_id, (1 + len(list_filter(range(2, len(s) + 1), lambda i: s[i] <> s[i - 1])))::INT AS n1 FROM (SELECT vec_id, list_filter(list_transform({DIFFS}, lambda v: sign(v)), lambda v: v <> 0) AS s FROM vectors)"""


@query("inflections", sql(_INFLECT))
def inflections(spark, sf):
    return vectors(spark, sf).select("vec_id", fa.inflections_1(F.col("x")).cast("int").alias("n1"))


@query("inflections_moved", sql("""SELECT vec_id, max(n)::INT AS n2 FROM walk GROUP BY vec_id""", """
walk AS (
  SELECT vec_id, x, 1 AS i, 0.0::DOUBLE AS s, 1 AS n, NULL::DOUBLE AS saddle FROM vectors
  UNION ALL
  SELECT vec_id, x, i + 1, CASE WHEN sl <> 0 THEN sl ELSE s END, n + CASE WHEN change AND (saddle IS NULL OR abs(x[i] - saddle) > 0.1) THEN 1 ELSE 0 END, CASE WHEN change THEN x[i] ELSE saddle END
  FROM (SELECT *, sl <> 0 AND s <> 0 AND sl <> s AS change FROM (SELECT *, sign(x[i + 1] - x[i])::DOUBLE AS sl FROM walk WHERE i < len(x)))
)"""))  # fmt: skip
def inflections_moved(spark, sf):
    return vectors(spark, sf).select("vec_id", fa.inflections_2(F.col("x"), 0.1).cast("int").alias("n2"))


@query("linear_stretch", sql("SELECT vec_id, i, x[i * 64 // 100 + 1] AS v FROM vectors, (SELECT unnest(range(0, 100)) AS i)"))
def linear_stretch(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(fa.linear_stretch(F.col("x"), 100)).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


_AT = {k: f"x[least(greatest(k + {k}, 0), 63) + 1]" for k in (-1, 0, 1, 2)}
_INTERPOLATED = {
    "linear": f"{_AT[0]} * (1.0 - f) + {_AT[1]} * f",
    "quadratic": f"{_AT[0]} * (f - 1.0) * (f - 2.0) / 2.0 - {_AT[1]} * f * (f - 2.0) + {_AT[2]} * f * (f - 1.0) / 2.0",
    "cubic": f"({_AT[2]} * (f + 1.0) - {_AT[-1]} * (f - 2.0)) * f * (f - 1.0) / 6.0 + ({_AT[0]} * (f - 1.0) - {_AT[1]} * f) * (f + 1.0) * (f - 2.0) / 2.0",
}


def _interpolation(kind: str):
    text = sql(f"SELECT vec_id, i, round({_INTERPOLATED[kind]}, {R}) AS v FROM (SELECT *, floor(i * 0.9::DOUBLE)::INT AS k, i * 0.9::DOUBLE - floor(i * 0.9::DOUBLE) AS f FROM vectors, (SELECT unnest(range(0, 70)) AS i))")

    @query(f"interp_{kind}", text)
    def run(spark, sf):
        values = fa.interpolate(F.col("x"), fa.scaled_positions(70, 0.9), kind)
        return vectors(spark, sf).select("vec_id", F.posexplode(values).alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", R).alias("v"))

    return run


for _kind in _INTERPOLATED:
    _interpolation(_kind)


@query("array_running_max", sql("SELECT vec_id, i, list_max(x[greatest(i - 3, 0) + 1 : least(i + 3, 63) + 1]) AS hi, list_min(x[greatest(i - 3, 0) + 1 : least(i + 3, 63) + 1]) AS lo FROM vectors, (SELECT unnest(range(0, 64)) AS i)"))
def array_running_max(spark, sf):
    both = F.arrays_zip(fa.running_extreme(F.col("x"), 3, True).alias("hi"), fa.running_extreme(F.col("x"), 3, False).alias("lo"))
    return vectors(spark, sf).select("vec_id", F.posexplode(both).alias("i", "b")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("b.hi").alias("hi"), F.col("b.lo").alias("lo"))


_ACF = f"""SELECT vec_id, k, round(v / max(v) OVER (PARTITION BY vec_id), 5) + 0.0 AS v FROM (
  SELECT vec_id, k, list_sum(list_transform(range(1, 65 - k), lambda j: z[j] * z[j + k])) * 64.0 / (64 - k) AS v FROM (SELECT vec_id, list_transform(x, lambda v: (v - {MEAN}) / {STD}) AS z FROM vectors), (SELECT unnest(range(0, 64)) AS k))"""


@query("autocorrelation", sql(_ACF))
def autocorrelation(spark, sf):
    return vectors(spark, sf).select("vec_id", F.posexplode(fa.autocorrelation(F.col("x"))).alias("k", "v")).select("vec_id", F.col("k").cast("long").alias("k"), (F.round("v", 5) + 0.0).alias("v"))


#: Each vector with the next one of its label, stretched to 16 samples.
PAIRS = """pairs AS (SELECT vec_id, list_transform(range(0, 16), lambda i: x[i * 64 // 16 + 1]) AS x, list_transform(range(0, 16), lambda i: y[i * 64 // 16 + 1]) AS y
  FROM (SELECT *, lead(x) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM vectors) WHERE y IS NOT NULL)"""


def pairs(spark, sf):
    v = vectors(spark, sf).withColumn("y", F.lead("x").over(W.partitionBy("label").orderBy("vec_id"))).where(F.col("y").isNotNull())
    return v.select("vec_id", fa.linear_stretch(F.col("x"), 16).alias("x"), fa.linear_stretch(F.col("y"), 16).alias("y"))


@query("octave_offset", sql("SELECT vec_id, CASE WHEN abs(d - r) <= 0.0125 THEN r ELSE 0 END + 0.0 AS octave, sign(d) * CASE WHEN a > 550 AND a < 850 THEN 700 WHEN a > 1050 AND a < 1350 THEN 1200 WHEN a > 1750 AND a < 2050 THEN 1900 ELSE 0 END + 0.0 AS fifth FROM (SELECT *, round(d / 0.1::DOUBLE) * 0.1::DOUBLE AS r, abs(d) * 10000 AS a FROM (SELECT vec_id, round(list_avg(x) - list_avg(y), 9) AS d FROM pairs))", PAIRS))
def octave_offset(spark, sf):
    d = F.round(fa.mean(F.col("x")) - fa.mean(F.col("y")), 9)
    return pairs(spark, sf).select("vec_id", (fa.octave_offset(d, F.lit(0.0), 0.1) + 0.0).alias("octave"), (fa.fifth_offset(d * 10000, F.lit(0.0)) + 0.0).alias("fifth"))


@query("point_distances", sql(f"SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: abs(x[i] - y[i]))), {R}) AS city, round(list_sum(list_transform(range(1, 17), lambda i: (x[i] - y[i]) * (x[i] - y[i]))), {R}) AS squared, round(list_sum(list_transform(range(1, 17), lambda i: least(abs(x[i] - y[i]) * 400 % 53.0, 53.0 - abs(x[i] - y[i]) * 400 % 53.0))), 4) AS folded FROM pairs", PAIRS))
def point_distances(spark, sf):
    x, y = F.col("x"), F.col("y")
    far = lambda c: F.transform(c, lambda v: v * 400)
    return pairs(spark, sf).select("vec_id", F.round(fa.sequence_distance(x, y, "city_block"), R).alias("city"), F.round(fa.sequence_distance(x, y), R).alias("squared"), F.round(fa.sequence_distance(far(x), far(y), "tmm"), 4).alias("folded"))


@query("lb_kim", sql(f"SELECT vec_id, round(pow(x[1] - y[1], 2) + pow(x[16] - y[16], 2), {R}) AS bound FROM pairs", PAIRS))
def lb_kim(spark, sf):
    return pairs(spark, sf).select("vec_id", F.round(fa.lb_kim(F.col("x"), F.col("y")), R).alias("bound"))


@query("lb_keogh", sql(f"SELECT vec_id, round(list_sum(list_transform(range(1, 17), lambda i: pow(greatest(y[i] - list_max(x[greatest(i - 2, 1) : least(i + 2, 16)]), list_min(x[greatest(i - 2, 1) : least(i + 2, 16)]) - y[i], 0), 2))), {R}) AS bound FROM pairs", PAIRS))
def lb_keogh(spark, sf):
    x = F.col("x")
    return pairs(spark, sf).select("vec_id", F.round(fa.lb_keogh(fa.running_extreme(x, 2, True), fa.running_extreme(x, 2, False), F.col("y")), R).alias("bound"))


def warping_sql(n: int, m: int, warp: Warp, source: str) -> str:
    """``source`` (with lists x and y) and a column c_i_j of every cell of the cost matrix, one diagonal on another."""
    band = max(n, m) if warp.band is None else max(warp.band, abs(n - m))
    cells: set[tuple[int, int]] = set()
    out = source
    for diagonal in range(n + m - 1):
        columns = []
        for i in range(max(0, diagonal - m + 1), min(n, diagonal + 1)):
            j = diagonal - i
            if abs(i - j) > band:
                continue
            d = f"pow(x[{i + 1}] - y[{j + 1}], 2)" if warp.kind == "sq_euclidean" else f"abs(x[{i + 1}] - y[{j + 1}])"
            if warp.local and i >= 2 and j >= 2:
                steps = [(i - 2, j - 1), (i - 1, j - 1), (i - 1, j - 2)]
            else:
                steps = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
            start = (i, j) == (0, 0) or warp.open_ends and (i == 0 or j == 0)
            before = [] if start else [f"c_{a}_{b}" for a, b in steps if (a, b) in cells]
            if start or before:
                columns.append((i, j, f"{d}{' + least(' + ', '.join(before) + ')' if before else ''} AS c_{i}_{j}"))
        cells |= {(i, j) for i, j, _ in columns}
        if columns:
            out = f"(SELECT *, {', '.join(c for _, _, c in columns)} FROM {out})"
    return out


def _dtw(name: str, warp: Warp):
    band = 16 if warp.band is None else warp.band
    last = "c_15_15" if not warp.open_ends else "least(" + ", ".join([f"c_15_{j}" for j in range(15 - band, 16)] + [f"c_{i}_15" for i in range(15 - band, 15)]) + ")"
    text = sql(f"SELECT vec_id, round(dist, {R}) AS dist FROM (SELECT vec_id, {last} AS dist FROM {warping_sql(16, 16, warp, 'pairs')})", PAIRS)

    @query(name, text)
    def run(spark, sf):
        return pairs(spark, sf).select("vec_id", F.round(simjoin.pair_distance(F.col("x"), F.col("y"), warp), R).alias("dist"))

    return run


_dtw("dtw_std", Warp())
_dtw("dtw_city", Warp(kind="city_block"))
_dtw("dtw_band", Warp(band=3))
_dtw("dtw_band_local", Warp(band=3, local=True))
_dtw("dtw_band_subseq", Warp(band=3, open_ends=True))
_dtw("dtw_band_subseq_local", Warp(band=3, local=True, open_ends=True))


@query("dtw_native", sql(f"SELECT vec_id, round(c_15_15, {R}) AS dist FROM {warping_sql(16, 16, Warp(band=2), 'pairs')}", PAIRS))
def dtw_native(spark, sf):
    """The same distance without Python: nested aggregates."""
    return pairs(spark, sf).select("vec_id", F.round(fa.dtw(F.col("x"), F.col("y"), 2), R).alias("dist"))


@query("dtw_path_length")
def dtw_path_length(spark, sf):
    return pairs(spark, sf).select("vec_id", simjoin.path_length(F.col("x"), F.col("y"), Warp(band=3)).alias("cells"))
