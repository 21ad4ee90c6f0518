import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.functions import arrays, samples as fs, warping
from tessitura.functions.warping import Warp
from tessitura.operators import aggregates, graph, melody, ml, series, simjoin, store, subsequences

SAMPLES = "rec_id long, idx long, t double, value double"


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(5)
    rows = [(r, i, float(i), float(v)) for r in range(4) for i, v in enumerate(rng.standard_normal(60).cumsum() + 10)]
    return spark.createDataFrame(rows, SAMPLES).repartition(3)


def windows_of(walk, length=6):
    return subsequences.sliding_windows(walk, length)


def pairs_by_hand(windows, warp):
    rows = sorted(windows.collect(), key=lambda r: (r.rec_id, r.sub_id))
    out = []
    for a, b in itertools.combinations(rows, 2):
        if a.rec_id == b.rec_id and not (a.e_time - b.s_time) * (b.e_time - a.s_time) > 0:
            d = warping.distances(np.array([a.data]), np.array([b.data]), warp)[0]
            out.append((a.rec_id, a.sub_id, b.sub_id, d, (a.s_time, a.e_time), (b.s_time, b.e_time)))
    return out


def test_pairs_in_blocks(walk):
    windows, warp = windows_of(walk), Warp(band=1)
    want = {p[:3]: p[3] for p in pairs_by_hand(windows, warp)}
    for block in (256, 7):
        found = simjoin.compared_pairs(windows, None, simjoin.Compare(warp=warp, self_join=True), block=block).collect()
        assert {(r.l_rec, r.l_sub, r.r_sub): pytest.approx(r.dist) for r in found} == want and len(found) == len(want)
        near = simjoin.compared_pairs(windows, None, simjoin.Compare(warp=warp, self_join=True, bound=4.0), block=block).collect()
        assert {(r.l_rec, r.l_sub, r.r_sub) for r in near} == {k for k, d in want.items() if d < 4.0}
        best = simjoin.best_pair(windows, warp).collect()
        assert {(r.l_rec, round(r.dist, 9)) for r in best} == {(k, round(min(d for p, d in want.items() if p[0] == k), 9)) for k in range(4)}


def test_discovery_modes(walk):
    windows, warp = windows_of(walk), Warp(band=1)
    every = pairs_by_hand(windows, warp)
    for rec in range(4):
        mine = [(p[3], p[4], p[5], k) for k, p in enumerate(every) if p[0] == rec]
        greedy = [every[k][1:3] for k in simjoin.greedy(sorted(mine, key=lambda p: (p[0], every[p[3]][1:3])), 3)]
        queue = [every[k][1:3] for k in simjoin.bounded_queue(mine, 3)]
        for mode, want in (("nms", greedy), ("ref", queue)):
            found = simjoin.motif_discovery(windows.where(F.col("rec_id") == rec), 3, warp, mode=mode).orderBy("rank").collect()
            assert [(r.l_sub, r.r_sub) for r in found] == want


def test_bound_leaves_the_queue_as_it_is():
    rng = random.Random(1)
    for _ in range(300):
        pairs = []
        for k in range(rng.randint(1, 40)):
            a, b = rng.randint(0, 60), rng.randint(0, 60)
            pairs.append((round(rng.random(), 2), (a, a + 5), (b, b + 5), k))
        full = simjoin.bounded_queue(pairs, 4)
        part = simjoin.bounded_queue([p for p in pairs if p[0] < 0.6], 4)
        assert [k for k in full if pairs[k][0] < 0.6] == part


def test_nearest_and_octaves(spark):
    rng = np.random.default_rng(8)
    rows = [(i // 10, i, 0.0, 0.0, (rng.standard_normal(5) * 100 + 1200 * (i % 3)).tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows, "rec_id long, sub_id long, s_time double, e_time double, data array<double>")
    how = simjoin.Compare(warp=Warp(band=1), apart=False, exclude_equal=True, octaves=1200.0)
    found = simjoin.nearest(frame, None, 4, how).collect()
    for r in rows:
        dist = []
        for s in rows:
            if s[1] != r[1]:
                d = np.mean(r[4]) - np.mean(s[4])
                o = np.copysign(np.floor(abs(d) / 1200 + 0.5), d) * 1200
                shift = o if abs(d - o) <= 150 else 0.0
                dist.append(warping.distances(np.array([r[4]]), np.array([s[4]]) + shift, Warp(band=1))[0])
        got = sorted(x.dist for x in found if x.l_sub == r[1])
        assert got == pytest.approx(sorted(dist)[:4])


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SAMPLES)
    windows = windows_of(none)
    assert simjoin.compared_pairs(windows, None, simjoin.Compare()).collect() == []
    assert simjoin.motif_discovery(windows, 3, Warp()).collect() == []
    assert melody.transcribe(none, 2).collect() == []
    assert graph.clustering(spark.createDataFrame([], "a long, b long")).collect() == []
    assert aggregates.histogram(none, "rec_id", F.col("value"), 0, 10, 1).collect() == []


def test_overlap_removal(spark):
    rows = [(1, 1, 0.0, 1.0, 3.0), (1, 2, 0.5, 1.5, 1.0), (1, 3, 1.51, 2.0, 2.0), (1, 4, 2.0, 3.0, 9.0), (2, 1, 0.0, 1.0, 3.0)]
    found = simjoin.remove_overlap(spark.createDataFrame(rows, "rec_id long, id long, s_time double, e_time double, dist double")).collect()
    assert {(r.rec_id, r.id): r.black for r in found} == {(1, 1): True, (1, 2): False, (1, 3): False, (1, 4): True, (2, 1): False}


def test_array_dtw_agrees_with_batches(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()) for i in range(30)]
    frame = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    found = frame.select("k", arrays.dtw(F.col("x"), F.col("y"), 2).alias("a"), simjoin.pair_distance(F.col("x"), F.col("y"), Warp(band=2)).alias("b")).collect()
    assert [r.a for r in found] == pytest.approx([r.b for r in found])


def test_pair_distance_of_nulls_and_mixed_lengths(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0, 3.0]), (2, None, [1.0]), (3, [], [1.0]), (4, [1.0], [4.0])], "k int, x array<double>, y array<double>")
    found = {r.k: r.d for r in frame.select("k", simjoin.pair_distance(F.col("x"), F.col("y"), Warp()).alias("d")).collect()}
    assert found == {1: 1.0, 2: None, 3: None, 4: 9.0}


def test_levels_and_lengths(spark):
    row = spark.range(1).select(fs.quantize_level(F.lit(135.0)).alias("a"), fs.quantize_level(F.lit(150.0)).alias("b"), fs.octave_fold(F.lit(-100.0)).alias("c"), fs.strip_prefix(F.lit("/x/y"), "/a", "/x").alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (100, None, 1100.0, "/y")
    assert subsequences.motif_lengths(2.0, 0.0222, (0.9, 0.95, 1.0, 1.05, 1.1)) == (91, [82, 86, 91, 95, 101])


def test_graph_measures(spark):
    rng = random.Random(3)
    edges = sorted({tuple(sorted(rng.sample(range(25), 2))) for _ in range(60)})
    frame = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in edges], "a long, b long, weight double")
    near = {n: {x for e in edges if n in e for x in e} - {n} for n in range(25)}
    for r in graph.clustering(frame).collect():
        k = len(near[r.node])
        triangles = sum(b in near[a] for a, b in itertools.combinations(near[r.node], 2))
        assert (r.degree, r.triangles) == (k, triangles) and r.coefficient == pytest.approx(2 * triangles / (k * (k - 1)) if k > 1 else 0)

    def paths(s, t):
        layer, out = [[s]], []
        while layer and not out:
            out = [p for p in layer if p[-1] == t]
            seen = {x for p in layer for x in p}
            layer = [p + [x] for p in layer for x in near[p[-1]] if x not in seen]
        return out

    want = dict.fromkeys((n for n in near if near[n]), 0.0)
    for s, t in itertools.combinations(want, 2):
        every = paths(s, t)
        for p in every:
            for x in p[1:-1]:
                want[x] += 1 / len(every)
    assert {r.node: pytest.approx(r.betweenness) for r in graph.betweenness(frame).collect()} == want
    other = graph.rewire(frame, 2.0, seed=4).collect()
    degree = lambda pairs: sorted(x for p in pairs for x in p)
    assert degree(edges) == degree([(r.a, r.b) for r in other]) and len({(r.a, r.b) for r in other}) == len(edges)
    assert {(r.a, r.b) for r in other} != set(edges)
    labels = graph.communities(frame, 6)
    assert {r.node for r in labels.collect()} == set(want)
    assert -0.5 <= graph.modularity(frame, labels).first()[0] <= 1


def test_store_ids_are_stable(spark):
    pairs = spark.createDataFrame([(2, 1, 0.0, 1.0, 5.0, 6.0, 0.3), (1, 1, 0.0, 1.0, 2.0, 3.0, 0.1), (1, 2, 4.0, 5.0, 8.0, 9.0, 0.2)], "rec long, rank int, s1 double, e1 double, s2 double, e2 double, dist double")
    patterns, matches = store.load_discovery(pairs)
    rows = {r.id: r for r in patterns.collect()}
    assert sorted(rows) == list(range(1, 7)) and all(rows[r.pair_id].pair_id == i for i, r in rows.items())
    assert {(r.source_id, r.target_id, r.version) for r in matches.collect()} >= {(1, 2, -1), (2, 1, -2), (5, 6, -1)}
    assert patterns.collect() == store.load_discovery(pairs.repartition(3))[0].collect() or {tuple(r) for r in patterns.collect()} == {tuple(r) for r in store.load_discovery(pairs.repartition(3))[0].collect()}


def test_classifiers(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.standard_normal(4) + 4 * (i % 3)).tolist()) for i in range(150)]
    frame = spark.createDataFrame(rows, "k long, label int, x array<double>")
    guesses = {r.k: r.guess for r in ml.gaussian_bayes(frame.where("k < 100"), frame, "k", "label", "x").collect()}
    assert np.mean([guesses[k] == c for k, c, _ in rows]) > 0.97
    found = ml.cross_validate(frame, "k", "label", "x", "logistic", 3).collect()
    assert len(found) == 150 and np.mean([r.truth == r.guess for r in found]) > 0.95
    folds = ml.stratified_folds(frame, "k", "label", 5).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {10}
    assert {r["count"] for r in ml.balanced(frame.where("k < 100 or label = 0"), "k", "label").groupBy("label").count().collect()} == {33}


def test_transcription_rules(spark):
    levels = [1, 1, 1, 2, 3, 3, 3, None, 3, 3, None, None, None, None, 3, 3]
    frame = spark.createDataFrame([(0, i, float(i), None if v is None else float(v)) for i, v in enumerate(levels)], SAMPLES)
    found = [(r.s_time, r.e_time, r.level) for r in melody.transcribe(frame, 2, 2).orderBy("s_time").collect()]
    assert found == [(0.0, 2.0, 1.0), (3.0, 9.0, 3.0), (14.0, 15.0, 3.0)]


def test_cleaning(spark):
    hz = [100.0] * 5 + [200.0] * 3 + [100.0] * 5
    frame = spark.createDataFrame([(0, i, float(i), v) for i, v in enumerate(hz)], SAMPLES)
    assert [r.value for r in melody.jump_fix(frame).orderBy("idx").collect()] == pytest.approx([100.0] * 13)
    gaps = spark.createDataFrame([(0, i, float(i), v) for i, v in enumerate([0.0, 10.0, 0.0, 0.0, 16.0, 0.0, 0.0, 0.0, 0.0, 20.0, 0.0])], SAMPLES)
    assert [r.value for r in series.fill_gaps(gaps, 0.0, 2).orderBy("idx").collect()] == [0.0, 10.0, 12.0, 14.0, 16.0, 0.0, 0.0, 0.0, 0.0, 20.0, 0.0]
    flat = spark.createDataFrame([(0, i, float(i), 50.0) for i in range(9)], SAMPLES)
    assert [r.value for r in melody.gaussian_smooth(flat, 1.0).collect()] == pytest.approx([50.0] * 9)
    line = spark.createDataFrame([(0, i, float(i), float(min(i, 20 - i))) for i in range(21)], SAMPLES)
    assert [(r.first, r.last) for r in melody.piecewise_linear(line, 1e-6).orderBy("first").collect()] == [(0, 10), (10, 20)]


def test_longest_segments(spark):
    frame = spark.createDataFrame([(0, 0, 10), (0, 5, 30), (0, 28, 33), (0, 40, 41)], "rec_id long, first long, last long")
    assert sorted((r.first, r.last) for r in melody.keep_longest(frame).collect()) == [(0, 4), (5, 30), (31, 33), (40, 41)]


def test_sample_operators_stay_in_the_jvm(spark):
    from tessitura import catalog

    here = "/root/testdata/sf0.001"
    if not os.path.isdir(here):
        pytest.skip("no tables")
    for name in ("hz_to_cents", "filter_silence", "running_std_local", "sliding_window", "uniform_scale", "bl_flat_std", "norm_z", "interp_cubic", "tfidf", "pitch_histogram"):
        plan = catalog.QUERIES[name](spark, here)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
