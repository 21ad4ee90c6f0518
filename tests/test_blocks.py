import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessitura.functions import warping
from tessitura.functions.warping import Warp
from tessitura.operators import blocks, graph, notes, simjoin

ROWS = "rec_id long, sub_id long, s_time double, e_time double, data array<double>"


def written(folder, x, labels):
    rows = {"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array([v.tolist() for v in np.asarray(x, np.float32)], pa.list_(pa.float32())), "label": pa.array(labels, pa.int32())}
    pq.write_table(pa.table(rows), f"{folder}/embeddings.parquet")
    return str(folder)


def by_sql(folder, name):
    with duckdb.connect() as base:
        base.sql(f"CREATE VIEW embeddings AS FROM '{folder}/embeddings.parquet'")
        return sorted(base.sql(__spark_entry__.oracle_sql()[name]).fetchall())


def by_query(spark, folder, name):
    return sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, folder).collect())


def sequences(spark, x, recs):
    return spark.createDataFrame([(r, k, 0.0, 0.0, v.tolist()) for k, (r, v) in enumerate(zip(recs, x, strict=True))], ROWS)


def test_ranks_by_rounded_distances(spark, tmp_path):
    """Distances that differ below the sixth digit are ties, which the key settles."""
    x = np.zeros((8, 64))
    x[1:, 0] = [0.1000004, 0.1000002, 0.1, 0.1000001, 0.2, 0.3, 0.4]
    folder = written(tmp_path, x, [3, 2, 1, 0, 3, 2, 1, 0])
    found = by_query(spark, folder, "pattern_knn")
    assert found == by_sql(folder, "pattern_knn") and [r[1] for r in sorted(found, key=lambda r: r[3]) if r[0] == 0] == [3, 2, 1]


@pytest.mark.parametrize("warp", [Warp(band=0), Warp(band=1), Warp(band=4), Warp()])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_nearest_against_all_pairs(spark, monkeypatch, warp, offset):
    """Several blocks, copies among the sequences, and a large offset that single precision does not hold."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 12)) + offset
    x[100:110] = x[0]
    recs = (np.arange(150) % 4).tolist()
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 40)
    rows = sequences(spark, x, recs)
    for within in (False, True):
        found = simjoin.nearest(rows, None, 3, simjoin.Compare(warp=warp, apart=False, exclude_equal=True, digits=6), within=within).collect()
        i, j = (v.ravel() for v in np.meshgrid(range(150), range(150), indexing="ij"))
        d = blocks.rounded(warping.distances(x[i], x[j], warp), 6).reshape(150, 150)
        for k in range(150):
            others = [o for o in range(150) if o != k and (not within or recs[o] == recs[k])]
            want = sorted(others, key=lambda o: (d[k, o], recs[o], o))[:3]
            assert [r.r_sub for r in sorted((r for r in found if r.l_sub == k), key=lambda r: r["rank"])] == want


def test_communities_compute_edges_once(spark):
    """The edges may come from a comparison of all with all, so rounds must not repeat it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)], "a long, b long").mapInArrow(run, "a long, b long")
    found = {r.node: r.community for r in graph.communities(edges, 3).collect()}
    assert found[0] == found[1] == found[2] and found[5] == found[6] == found[7] != found[0]
    assert seen.value == 6


def test_betweenness_of_many_edges(spark):
    """More than two million edges, which were refused: all pairs of 2003 nodes but one, whose paths the others share."""
    ids = spark.range(2003)
    edges = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.col("a") < F.col("b")).where("NOT (a = 5 AND b = 9)")
    found = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert len(found) == 2003 and all(x == pytest.approx(0.0 if k in (5, 9) else 1 / 2001) for k, x in found.items())


def test_betweenness_of_parts(spark):
    """Parts of the graph, a node joined to itself alone, and a path of known counts."""
    edges = [(0, 1), (1, 2), (2, 3), (10, 11), (20, 20)]
    found = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {0: 0.0, 1: 2.0, 2: 2.0, 3: 0.0, 10: 0.0, 11: 0.0, 20: 0.0}


def test_ranks_pairs_by_rounded_roots(spark, tmp_path):
    """The closest pairs by distances of six digits, ties by key."""
    x = np.zeros((8, 64))
    for k, apart in enumerate([0.1000004, 0.1000003, 0.1000002, 0.1000001]):
        x[2 * k : 2 * k + 2, k], x[2 * k + 1, 20 + k] = 10.0, apart
    folder = written(tmp_path, x, [0] * 8)
    assert by_query(spark, folder, "mk_motif") == by_sql(folder, "mk_motif") == [(0, 1, 0.1), (2, 3, 0.1), (4, 5, 0.1)]


def test_vectors_are_not_copied(spark, tmp_path):
    """Nearest neighbours of all vectors come from blocks in files: no row is repeated for blocks, no pair is shuffled."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 64))
    folder = written(tmp_path, x, (np.arange(600) % 3).tolist())
    query = __spark_entry__.queries()["knn_classify"](spark, folder)
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    y = np.asarray(x, np.float32).astype(float)[:, np.arange(16) * 4]
    square = ((y[:, None] - y) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    near = np.argsort(square, axis=1)[:, :5] % 3
    assert {r.vec_id: r.guess for r in query.collect()} == {k: max(range(3), key=lambda c: ((v == c).sum(), -c)) for k, v in enumerate(near)}


def test_edges_of_labels_in_blocks(spark, tmp_path):
    """Labels larger than a block and labels that share one; no vector is repeated for blocks."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((420, 64))
    x[:160] = x[0] + 0.05 * x[:160]
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[300:310] = x[10]
    folder = written(tmp_path, x, [0] * 330 + [k % 9 + 1 for k in range(90)])
    for name in ("graph_threshold", "edge_intersection"):
        query = __spark_entry__.queries()[name](spark, folder)
        assert "Generate" not in query._jdf.queryExecution().optimizedPlan().toString()
        found = sorted(tuple(r) for r in query.collect())
        assert found == by_sql(folder, name) and found


def surfaces(spark):
    rng = np.random.default_rng(4)
    rows = {(r, int(i), int(j)): int(n) for r in range(130) for i, j, n in rng.integers(0, [6, 6, 9], (int(rng.integers(1, 12)), 3)) + [0, 0, 1]}
    rows |= {(r + 200, i, j): n for (r, i, j), n in rows.items() if r < 30}
    frame = spark.createDataFrame([(*k, n) for k, n in rows.items()] + [(0, None, 2, 5)], "rec_id long, i int, j int, n long")
    total = {r: sum(n for k, n in rows.items() if k[0] == r) + 5 * (r == 0) for r in {k[0] for k in rows}}
    share = {r: {k[1:]: n / total[r] for k, n in rows.items() if k[0] == r} for r in total}
    return frame, share, {r: sum(v * v for v in s.values()) + (5 / total[r]) ** 2 * (r == 0) for r, s in share.items()}


def test_surface_distances_in_blocks(spark, monkeypatch):
    """Blocks, few cells at a time, surfaces that share none and a cell that isn't known; no cell is joined."""
    frame, share, squares = surfaces(spark)
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 50)
    found = notes.surface_distances(frame)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.a, r.b): (r.euclidean, r.bhattacharyya) for r in found.collect()}
    want = {(a, b): [share[a][c] * share[b][c] for c in share[a].keys() & share[b].keys()] for a in share for b in share if a < b}
    want = {k: (max(0.0, squares[k[0]] + squares[k[1]] - 2 * sum(v)) ** 0.5, -np.log(sum(x**0.5 for x in v))) for k, v in want.items() if v}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_surface_distances_of_copies(spark, tmp_path, monkeypatch):
    """Many copies of few recordings, one of them more often than counts as one: each pair of recordings once, as in SQL,
    and the result takes room by the surfaces that differ."""
    rng = np.random.default_rng(9)
    value = {u: rng.uniform(0, 120, 30) for u in range(12)}
    users = [(u + 100 * k, u) for u in value for k in range(90 if u else 150)] + [(50000, 12), (50001, 13)]
    value |= {12: rng.uniform(0, 120, 30), 13: rng.uniform(9000, 9100, 5)}
    rows = [(n, 1000000 * k, user, float(v)) for n, (user, u) in enumerate(users) for k, v in enumerate(value[u])]
    columns = dict(zip(("event_id", "ts", "user_id", "value"), zip(*rows, strict=True), strict=True))
    types = {"event_id": pa.int64(), "ts": pa.timestamp("us"), "user_id": pa.int64(), "value": pa.float64()}
    pq.write_table(pa.table({k: pa.array(v, types[k]) for k, v in columns.items()}), f"{tmp_path}/events.parquet")
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 400)
    monkeypatch.setattr(notes, "_COPIES", 64)
    __spark_entry__.queries()["surface_distances"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    with duckdb.connect() as base:
        base.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'; CREATE TABLE found AS FROM '{tmp_path}/out/*.parquet'")
        base.sql(f"CREATE TABLE wanted AS {__spark_entry__.oracle_sql()['surface_distances']}")
        n, wanted = (base.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("found", "wanted"))
        same = base.sql("SELECT count(*) FROM found f JOIN wanted w USING (a, b) WHERE abs(f.euclidean - w.euclidean) < 2e-6 AND abs(f.bhattacharyya - w.bhattacharyya) < 2e-6").fetchall()[0][0]
    assert n == wanted == same == 1141 * 1140 // 2
    assert sum(p.stat().st_size for p in tmp_path.glob("out/*.parquet")) < n


def test_nearest_surfaces_without_pairs(spark, monkeypatch):
    """Copies of surfaces are ties, which the key settles; no pair is shuffled or joined."""
    frame, share, _ = surfaces(spark)
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 50)
    found = notes.nearest_surfaces(frame, 3, 9)
    assert not any(x in found._jdf.queryExecution().optimizedPlan().toString() for x in ("Join", "Window", "Aggregate"))
    far = {(a, b): sum((share[a][c] * share[b][c]) ** 0.5 for c in share[a].keys() & share[b].keys()) for a in share for b in share if a != b}
    far = {k: round(-float(np.log(v)), 9) + 0.0 for k, v in far.items() if v > 0}
    want = {(a, b, rank) for a in share for rank, (_, b) in enumerate(sorted((d, b) for (x, b), d in far.items() if x == a)[:3], 1)}
    assert {(r.a, r.b, r["rank"]) for r in found.collect()} == want


def test_variable_lengths_are_not_copied(spark, tmp_path):
    """Neighbours of z-normalised patterns under warping; no pattern is repeated for blocks."""
    x = np.random.default_rng(6).standard_normal((200, 64))
    folder = written(tmp_path, x, (np.arange(200) % 3).tolist())
    query = __spark_entry__.queries()["search_var_len"](spark, folder)
    assert "Generate" not in query._jdf.queryExecution().optimizedPlan().toString()
    y = np.asarray(x, np.float32).astype(float)[:, np.arange(24) * 64 // 24]
    y = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, keepdims=True)
    i, j = (v.ravel() for v in np.meshgrid(range(200), range(200), indexing="ij"))
    far = warping.distances(y[i], y[j], Warp(band=5)).reshape(200, 200)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :5]
    assert {(r.l_sub, r.r_sub, r["rank"]) for r in query.collect()} == {(a, b, rank) for a in range(200) for rank, b in enumerate(near[a].tolist(), 1)}


def copies(spark, seed=5):
    """Copies of few sequences, one of them very often, in recordings of very different size; some keys are there twice."""
    rng = np.random.default_rng(seed)
    some = rng.integers(0, 3, (25, 6)) + rng.standard_normal((25, 6)).round(1)
    which = np.r_[rng.integers(0, 25, 180), np.zeros(220, int)]
    recs = np.where(rng.random(400) < 0.7, 0, rng.integers(1, 9, 400))
    keys = np.arange(400)
    keys[[50, 60]], recs[[50, 60]], which[60] = keys[[51, 61]], recs[[51, 61]], which[61]
    rows = [(int(r), int(k), float(k), float(k + 1), some[w].tolist()) for r, k, w in zip(recs, keys, which, strict=True)]
    return spark.createDataFrame(rows, ROWS), recs, keys, some[which]


@pytest.mark.parametrize("warp", [Warp(band=0), Warp(band=2)])
def test_nearest_of_copies(spark, monkeypatch, warp):
    """Copies are compared once, dealt out where they are many; ties go by key and a key never finds itself."""
    rows, recs, keys, x = copies(spark)
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 8)
    monkeypatch.setattr(blocks, "VALUES", 1)
    i, j = (v.ravel() for v in np.meshgrid(range(400), range(400), indexing="ij"))
    d = warping.distances(x[i], x[j], warp).reshape(400, 400)
    for within in (False, True):
        found = simjoin.nearest(rows, None, 3, simjoin.Compare(warp=warp, apart=False, exclude_equal=True, digits=6), within=within).collect()
        want = []
        for a in range(400):
            others = [b for b in range(400) if (recs[a], keys[a]) != (recs[b], keys[b]) and (not within or recs[a] == recs[b])]
            others.sort(key=lambda b: (round(d[a, b], 6), recs[b], keys[b]))
            want += [(recs[a], keys[a], recs[b], keys[b], keys[a], keys[b] + 1.0, round(d[a, b], 6), rank) for rank, b in enumerate(others[:3], 1)]
        assert sorted((r.l_rec, r.l_sub, r.r_rec, r.r_sub, r.l_s, r.r_e, round(r.dist, 6), r["rank"]) for r in found) == sorted(want)


def test_copies_are_compared_once(spark, tmp_path):
    """60,000 vectors of which 20 differ: pairs of copies are neither compared nor listed."""
    rng = np.random.default_rng(2)
    some, of = rng.standard_normal((20, 64)), np.arange(60000) % 20
    folder = written(tmp_path, some[of], (of % 7).tolist())
    from tessitura.plans.window_queries import patterns

    spool, cells = blocks.spooled(patterns(spark, folder), False, 6)
    assert sum(len(blocks.distinct(spool, name)["copies"]) for cell in cells for name, _ in cell) == 20
    found = {r.vec_id: r.guess for r in __spark_entry__.queries()["knn_classify"](spark, folder).collect()}
    assert found == {k: v % 7 for k, v in enumerate(of.tolist())}


@pytest.mark.parametrize("within", [False, True])
def test_pairs_of_copies(spark, monkeypatch, within):
    """Copies are compared once, and all or the best of their pairs come out, smaller keys on the left."""
    rows, recs, keys, x = copies(spark)
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 8)
    monkeypatch.setattr(blocks, "VALUES", 1)
    square = ((x[:, None] - x) ** 2).sum(axis=2)
    every = [(a, b) for a in range(400) for b in range(400) if (recs[a], keys[a]) < (recs[b], keys[b]) and (not within or recs[a] == recs[b])]
    want = sorted((round(square[a, b], 6), recs[a], keys[a], recs[b], keys[b], keys[a] + 1.0, float(keys[b])) for a, b in every)
    found = lambda how: sorted((round(r.dist, 6), r.l_rec, r.l_sub, r.r_rec, r.r_sub, r.l_e, r.r_s) for r in simjoin.compared_pairs(rows, None, how, within=within).collect())
    assert found(simjoin.Compare(warp=Warp(band=0), apart=False, self_join=True, bound=4.005)) == [p for p in want if p[0] < 4.005]
    best = found(simjoin.Compare(warp=Warp(band=0), apart=False, self_join=True, best=7, digits=6))
    assert best[:7] == want[:7] and set(best) <= set(want)


def test_closest_pairs_of_copies(spark, tmp_path):
    """60,000 vectors of which 20 differ have 90 million pairs of copies; the closest three are those of the first keys."""
    x = np.random.default_rng(2).standard_normal((20, 64))[np.arange(60000) % 20]
    folder = written(tmp_path, x, [0] * 60000)
    assert by_query(spark, folder, "mk_motif") == [(0, 20, 0.0), (0, 40, 0.0), (0, 60, 0.0)]


def test_edges_of_copies(spark, tmp_path, monkeypatch):
    """Groups of copies, some of them split, give the edges of all their members; their many pairs at no distance are not made."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((40, 64))
    x[:30] = x[0] + rng.uniform(0.005, 0.09, (30, 1)) * x[:30]
    x = x[np.r_[np.arange(40), np.zeros(150, int), rng.integers(0, 40, 110)]]
    labels = np.r_[np.zeros(250, int), rng.integers(0, 4, 50)].tolist()
    monkeypatch.setattr(blocks, "block_size", lambda rows, blocks=0: 8)
    monkeypatch.setattr(blocks, "VALUES", 1)
    folder = written(tmp_path, x, labels)
    found = by_query(spark, folder, "edge_intersection")
    assert found and found == by_sql(folder, "edge_intersection")


def test_edges_of_very_many_copies(spark, tmp_path):
    """30,000 copies have 450 million pairs at no distance, which are no edges; each has two edges, of which the stronger stays."""
    x = np.zeros((30002, 64))
    x[:, 0], x[30000:, 0] = 1.0, [1.4, 2.05]
    found = by_query(spark, written(tmp_path, x, [0] * 30002), "edge_intersection")
    assert found == [(k, 30000) for k in range(30000)]
