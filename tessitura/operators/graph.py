"""Similarity graphs: undirected edges a < b, with weights."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks
from .lineage import cut, numbered, shared_folder, stored, tasks

#: Fifty thresholds up to 5e6, spaced by squares.
THRESHOLDS = [5e6 * (k / 49) ** 2 for k in range(50)]


def threshold_edges(pairs: DataFrame, below: float) -> DataFrame:
    """Distinct edges of pairs (a, b, dist) nearer than ``below``."""
    near = pairs.where((F.col("dist") < below) & (F.col("a") != F.col("b")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def weighted_edges(pairs: DataFrame, kind: str = "inverse", below: float | None = None) -> DataFrame:
    """Edges with weight 1/d, exp(-d / mean d) or 1; of repeated edges the one with the greatest distance counts."""
    rows = pairs.where((F.col("a") != F.col("b")) & (F.col("dist") > 0))
    if below is not None:
        rows = rows.where(F.col("dist") < below)
    rows = rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("dist").alias("dist"))
    if kind == "exp":
        rows = rows.join(F.broadcast(rows.agg(F.avg("dist").alias("mean"))))
        return rows.select("a", "b", F.exp(-F.col("dist") / F.col("mean")).alias("weight"))
    return rows.select("a", "b", (1.0 / F.col("dist") if kind == "inverse" else F.lit(1.0)).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("a", "b")]
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree and, if there are weights, strength."""
    both = both_ways(edges)
    more = [F.sum("weight").alias("strength")] if "weight" in edges.columns else []
    return both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), *more)


def disparity_filter(edges: DataFrame, alpha: float, endpoint: str = "first") -> DataFrame:
    """Edges that are significant at ``alpha``: (1 - w / strength)^(degree - 1) < alpha at the first end, or at either."""
    ends = degrees(edges)
    joined = edges.join(ends.select(F.col("node").alias("a"), F.col("degree").alias("ka"), F.col("strength").alias("sa")), "a")
    joined = joined.join(ends.select(F.col("node").alias("b"), F.col("degree").alias("kb"), F.col("strength").alias("sb")), "b")

    def p(k: str, s: str) -> Column:
        return F.pow(F.greatest(F.lit(0.0), 1 - F.col("weight") / F.col(s)), F.col(k) - 1)

    keep = p("ka", "sa") < alpha
    if endpoint == "either":
        keep = keep | (p("kb", "sb") < alpha)
    return joined.where(keep).select("a", "b", "weight")


def significant_groups(pairs: DataFrame, members: DataFrame, below: float, near: float, alpha: float) -> DataFrame:
    """Edges a < b nearer than ``near`` that the disparity filter keeps in the graph of inverse distances ``below``, where
    nodes come in groups of equal neighbours: pairs of groups (p, q, n_p, n_q, dist) and members (group, node).

    Nodes of a group have the same degree and strength, so both are summed over pairs of groups; only edges that stay are made.
    """
    pairs = stored(pairs.where((F.col("dist") > 0) & (F.col("dist") < below)), "groups")
    weight = 1.0 / F.col("dist")
    both = pairs.select("p", F.col("n_q").alias("n"), weight.alias("w")).unionByName(pairs.select(F.col("q").alias("p"), F.col("n_p").alias("n"), weight.alias("w")))
    ends = both.groupBy("p").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("w")).alias("s"))

    test = F.pow(F.greatest(F.lit(0.0), 1 - weight / F.col("s")), F.col("k") - 1) < alpha
    some = pairs.where(F.col("dist") < near)
    for group in ("p", "q"):
        some = some.join(ends.withColumnRenamed("p", group), group).withColumn(f"keep_{group}", test).drop("k", "s")
    some = some.where("keep_p OR keep_q").select("p", "q", "keep_p", "keep_q")
    one, two = members.select(F.col("group").alias("p"), F.col("node").alias("x")), members.select(F.col("group").alias("q"), F.col("node").alias("y"))
    made = some.join(one, "p").join(two, "q").where("(x < y AND keep_p) OR (y < x AND keep_q)")
    return made.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, triangles and its clustering coefficient; nodes of one edge have 0.

    Edges run from the end of smaller degree to the other, so a hub's edges are never paired with each other.
    """
    degree = degrees(edges.select("a", "b"))
    da, db = degree.select(F.col("node").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node").alias("b"), F.col("degree").alias("db"))
    ranked = edges.select("a", "b").join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.alias("x").join(out.alias("y"), (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v"))).select(F.col("x.u").alias("n"), F.col("x.v").alias("p"), F.col("y.v").alias("q"))
    closed = wedge.join(edges.select(F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"], "left_semi")
    corners = closed.select(F.explode(F.array("n", "p", "q")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    joined = degree.join(corners, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    k = F.col("degree")
    return joined.select("node", "degree", "triangles", F.when(k > 1, 2.0 * F.col("triangles") / (k * (k - 1))).otherwise(0.0).alias("coefficient"))


def edge_intersection(edges: DataFrame, other: DataFrame) -> DataFrame:
    return edges.join(other.select("a", "b"), ["a", "b"], "left_semi")


def communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node and community by label propagation: each round every node takes the label of greatest weight among its
    neighbours and its own, the smallest of equals. Deterministic; a fixed number of rounds, each cut by a checkpoint."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    both = both_ways(stored(edges.select("a", "b", weight.alias("weight")), "edges"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "community"), "b").select(F.col("a").alias("node"), "community", "weight")
        own = labels.select("node", "community", F.lit(1e-9).alias("weight"))
        votes = seen.unionByName(own).groupBy("node", "community").agg(F.round(F.sum("weight"), 9).alias("votes"))
        labels = votes.groupBy("node").agg(F.max_by("community", F.struct("votes", -F.col("community"))).alias("community"))
        labels = cut(labels)
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Newman's modularity of a division into communities, one row."""
    weight = F.col("weight") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("a", "b", weight.alias("w"))
    named = e.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = named.agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("m"))
    ends = named.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), "w"), F.struct(F.col("cb").alias("c"), "w"))).alias("e")).groupBy("e.c").agg(F.sum("e.w").alias("s"))
    squares = ends.agg(F.sum(F.col("s") * F.col("s")).alias("squares"))
    return inside.join(F.broadcast(squares)).select((F.col("inside") / F.col("m") - F.col("squares") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _rows_of(first: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the list of neighbours of all neighbours of ``nodes``, and how many each has."""
    size = first[nodes + 1] - first[nodes]
    return np.arange(size.sum()) + np.repeat(first[nodes] - (np.cumsum(size) - size), size), size


def _brandes(first: np.ndarray, after: np.ndarray, source: int, share: np.ndarray) -> None:
    """Add to ``share`` what each node has of the shortest paths from ``source``; neighbours of v: after[first[v]:first[v+1]].

    The search goes level by level, each a few vector operations over the edges that leave it.
    """
    n = len(first) - 1
    seen, paths = np.zeros(n, bool), np.zeros(n)
    seen[source], paths[source] = True, 1.0
    level, steps = np.array([source]), []
    while len(level):
        at, size = _rows_of(first, level)
        to = after[at]
        fresh = np.flatnonzero(~seen[to])
        to, by = to[fresh], np.repeat(level, size)[fresh]
        if not len(to):
            break
        steps.append((by, to))
        seen[to] = True
        reached = np.bincount(to, paths[by], n)
        level = np.flatnonzero(reached)
        paths[level] = reached[level]
    below = np.zeros(n)
    for by, to in reversed(steps):
        below += np.bincount(by, ((1.0 + below) / np.where(seen, paths, 1.0))[to] * paths[by], n)
    below[source] = 0.0
    share += below


#: Nodes that small connected parts of a graph share a file up to; sources times edges of a task.
_PACK, _WORK = 4096, 150_000_000


def _packed(folder: str):
    """Writes a graph as files of whole connected parts: nodes with the ends of their lists of neighbours, and these lists."""

    def run(table: pa.Table) -> pa.Table:
        a, b = (table.column(c).to_numpy() for c in "ab")
        nodes, ends = np.unique(np.r_[a, b], return_inverse=True)
        n, m = len(nodes), len(a)
        u, v = np.r_[ends[:m], ends[m:]].astype(np.int32), np.r_[ends[m:], ends[:m]].astype(np.int32)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        first = np.searchsorted(u, np.arange(n + 1))
        part = np.arange(n, dtype=np.int32)
        while n:
            low = np.minimum(part, np.minimum.reduceat(part[v], first[:-1]))
            low = low[low]
            if (low == part).all():
                break
            part = low
        sizes = np.bincount(part, minlength=n)
        # Parts in the order of their least node; each file takes parts until it has _PACK nodes.
        before = np.cumsum(sizes) - sizes
        file = (before // _PACK)[part]
        out = []
        for f in np.unique(file).tolist():
            mine = np.flatnonzero(file == f)
            local = np.zeros(n, np.int32)
            local[mine] = np.arange(len(mine))
            at, size = _rows_of(first, mine)
            name = blocks.put(folder, pa.table({"node": nodes[mine], "after": pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(size)], local[v[at]])}))
            out.append((name, len(mine), len(at)))
        return pa.table({"name": pa.array([o[0] for o in out], pa.string()), "nodes": pa.array([o[1] for o in out], pa.int64()), "ends": pa.array([o[2] for o in out], pa.int64())})

    return run


def betweenness(edges: DataFrame) -> DataFrame:
    """node and exact betweenness (unweighted paths, each pair once).

    Every source is a search over its connected part of the graph. One task writes these parts to files of the shared
    folder; the sources of each are dealt out to tasks that read that file alone.
    """
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/tessitura/graph-{uuid.uuid4().hex}"
    files = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(0).alias("all")).groupBy("all").applyInArrow(_packed(folder), "name string, nodes long, ends long").collect()
    work = []
    for f in files:
        some = max(1, _WORK // max(1, f.ends + 8 * f.nodes))
        work += [(f.name, at, min(f.nodes, at + some)) for at in range(0, f.nodes, some)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                name, low, high = work[t]
                graph = blocks.get(folder, name)
                after = graph.column("after").combine_chunks()
                first, after = after.offsets.to_numpy(), after.flatten().to_numpy()
                share = np.zeros(len(first) - 1)
                for source in range(low, high):
                    _brandes(first, after, source, share)
                yield pa.record_batch({"node": graph.column("node").combine_chunks(), "part": pa.array(share / 2)})

    parts = tasks(spark, len(work)).mapInArrow(run, "node long, part double")
    return parts.groupBy("node").agg(F.sum("part").alias("betweenness"))


def rewire(edges: DataFrame, swaps_per_node: float = 1.0, seed: int = 0) -> DataFrame:
    """A random graph with the same degrees, by double edge swaps within each connected block of edges given as one part.

    Edges are swapped within ``part`` groups if the table has that column, else all together as one group.
    """
    rows = edges.select("a", "b", (F.col("part") if "part" in edges.columns else F.lit(0)).cast("long").alias("part"))

    def run(table: pa.Table) -> pa.Table:
        rng = np.random.default_rng([seed, int(table.column("part")[0].as_py())])
        pairs = list(zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True))
        there = {tuple(sorted(p)) for p in pairs}
        wanted = int(swaps_per_node * len({x for p in pairs for x in p}))
        for _ in range(100 * wanted):
            if wanted <= 0 or len(pairs) < 2:
                break
            i, j = rng.choice(len(pairs), 2, replace=False).tolist()
            (a, b), (c, d) = pairs[i], pairs[j]
            if rng.random() < 0.5:
                c, d = d, c
            fresh = [tuple(sorted((a, d))), tuple(sorted((c, b)))]
            if len({a, b, c, d}) == 4 and not any(f in there for f in fresh):
                there -= {tuple(sorted(pairs[i])), tuple(sorted(pairs[j]))}
                there |= set(fresh)
                pairs[i], pairs[j] = fresh
                wanted -= 1
        a, b = zip(*(sorted(p) for p in pairs), strict=True)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def rank_by_class(members: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Communities (community, node, label) ranked by size, purity to the fourth power and the centroid of label ranks.

    Communities of several labels whose largest share is below ``least_share`` rank -100.
    """
    counts = members.groupBy("community", "label").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("community").orderBy(F.col("n").desc(), "label")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    per = ranked.groupBy("community").agg(F.sum("n").alias("size"), F.max("n").alias("most"), F.count(F.lit(1)).alias("labels"), F.min_by("label", "rank").alias("label"), (F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias("centroid"))
    share = F.col("most") / F.col("size")
    score = F.when((F.col("labels") >= 2) & (share < least_share), -100.0).otherwise(F.round(F.col("size") * F.pow(share, 4) * F.col("centroid"), 2))
    return per.select("community", "label", "size", score.alias("score"))


def single_label_communities(members: DataFrame) -> DataFrame:
    return members.groupBy("community").agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("size")).where(F.col("labels") == 1).select("community", "size")


def nearest_community(links: DataFrame, members: DataFrame, missing: float = 5_000_000.0, how: str = "min") -> DataFrame:
    """For each outside node of links (node, member, dist): the community nearest by its least or mean distance.

    In the mean a member without a link counts as ``missing``; so do communities without any link, and they never win
    against one that has a link.
    """
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    joined = links.join(members.select(F.col("node").alias("member"), "community"), "member")
    per = joined.groupBy("node", "community").agg(F.min("dist").alias("least"), F.sum("dist").alias("total"), F.count(F.lit(1)).alias("n")).join(sizes, "community")
    mean = (F.col("total") + (F.col("size") - F.col("n")) * F.lit(missing)) / F.col("size")
    dist = F.col("least") if how == "min" else mean
    return per.groupBy("node").agg(F.min_by("community", F.struct(dist.alias("d"), "community")).alias("community"), F.min(dist).alias("dist"))


def ordered_nodes(nodes: DataFrame, *by: str) -> DataFrame:
    """Nodes with rank from 1, by measures from the largest down and then by node."""
    less = [f"_less{i}" for i in range(len(by))]
    return numbered(nodes.withColumns({n: -F.col(c) for n, c in zip(less, by, strict=True)}), "rank", *less, "node").drop(*less).withColumn("rank", F.col("rank") + 1)
