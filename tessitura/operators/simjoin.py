"""Similarity joins of subsequences under warping distances with lower bounds.

Pairs are never rows of a join. Both sides are cut into blocks, each pair of blocks is one task group with at most
2 * BLOCK sequences, and inside it LB_Kim, LB_Keogh and the warping distance run over arrays of pairs; only what is asked
for leaves the group. A recording with very many subsequences is many groups, so it can't land in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import warping
from ..functions.warping import Warp
from . import blocks
from .subsequences import SCALE_PAIRS

#: Sequences of one side in a task group, and pairs whose distances are computed at once.
BLOCK, BATCH = 256, 4096


@dataclass(frozen=True)
class Compare:
    """What is compared and kept.

    bound: only distances below it (or up to it, if inclusive). best: the best so many of each ``per`` ('group' of blocks,
    or 'left' sequence). apart: subsequences of one recording must not overlap in time. scales: number of time scales; the
    scale is sub_id % scales. octaves: shift the right side by whole octaves of this size. self_join: only left < right.
    digits: the best are chosen by distances rounded to so many digits, with ``root`` by their square roots, then by keys.
    """

    warp: Warp = Warp()
    bound: float = float("inf")
    inclusive: bool = False
    best: int | None = None
    per: str = "group"
    apart: bool = True
    scales: int = 1
    octaves: float | None = None
    self_join: bool = False
    exclude_equal: bool = False
    digits: int | None = None
    root: bool = False

    @property
    def plain(self) -> bool:
        """Whether all that counts of a self join is the distance, squared and of whole sequences."""
        return not self.apart and self.scales == 1 and not self.octaves and not self.warp.local and not self.warp.open_ends and self.warp.kind == "sq_euclidean"


FIELDS = "l_rec long, l_sub long, r_rec long, r_sub long, l_s double, l_e double, r_s double, r_e double, dist double"
_ARROW = pa.schema([("l_rec", pa.int64()), ("l_sub", pa.int64()), ("r_rec", pa.int64()), ("r_sub", pa.int64()), *[(c, pa.float64()) for c in ("l_s", "l_e", "r_s", "r_e", "dist")]])


def _compared(how: Compare):
    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        left, right = (blocks.side(rows.filter(pa.array(side == s))) for s in (0, 1))
        if not len(left["sub_id"]) or not len(right["sub_id"]):
            return _ARROW.empty_table()
        i, j = np.meshgrid(np.arange(len(left["sub_id"])), np.arange(len(right["sub_id"])), indexing="ij")
        i, j = i.ravel(), j.ravel()
        same = left["rec_id"][i] == right["rec_id"][j]
        keep = np.ones(len(i), bool)
        if how.self_join:
            keep &= (left["rec_id"][i] < right["rec_id"][j]) | (same & (left["sub_id"][i] < right["sub_id"][j]))
        elif how.exclude_equal:
            keep &= ~(same & (left["sub_id"][i] == right["sub_id"][j]))
        if how.apart:
            shared = (left["e_time"][i] - right["s_time"][j]) * (right["e_time"][j] - left["s_time"][i]) > 0
            keep &= ~(same & shared)
        if how.scales > 1:
            allowed = [a * how.scales + b for a, b in SCALE_PAIRS[how.scales]]
            keep &= np.isin(left["sub_id"][i] % how.scales * how.scales + right["sub_id"][j] % how.scales, allowed)
        i, j = i[keep], j[keep]
        x, y = left["data"], right["data"]
        shift = np.zeros(len(i))
        if how.octaves:
            d = x.mean(axis=1)[i] - y.mean(axis=1)[j]
            r = np.copysign(np.floor(np.abs(d) / how.octaves + 0.5), d) * how.octaves
            shift = np.where(np.abs(d - r) <= how.octaves / 8, r, 0.0)
        within = (lambda v, b: v <= b) if how.inclusive else (lambda v, b: v < b)
        first = warping.cost(x[i, 0], y[j, 0] + shift, how.warp.kind) + warping.cost(x[i, -1], y[j, -1] + shift, how.warp.kind)
        bounded = not how.warp.local and not how.warp.open_ends
        if bounded:
            keep = within(first, how.bound) if np.isfinite(how.bound) else np.ones(len(i), bool)
            i, j, shift, low = i[keep], j[keep], shift[keep], first[keep]
        else:
            low = np.zeros(len(i))
        if bounded and how.warp.band is not None and x.shape[1] == y.shape[1]:
            upper, lower = warping.envelope(x, how.warp.band)
            for at in range(0, len(i), 1 << 15):
                part = slice(at, at + (1 << 15))
                low[part] = np.maximum(low[part], warping.keogh(upper[i[part]], lower[i[part]], y[j[part]] + shift[part, None], how.warp.kind))
        if np.isfinite(how.bound):
            keep = within(low, how.bound)
            i, j, shift, low = i[keep], j[keep], shift[keep], low[keep]
        if not len(i):
            return _ARROW.empty_table()
        # Cheap bounds first: once enough good pairs are known, whatever is bounded above them needs no warping.
        order = np.argsort(low, kind="stable")
        i, j, shift, low = i[order], j[order], shift[order], low[order]
        dist = np.full(len(i), np.inf)
        worst = how.bound
        for at in range(0, len(i), BATCH):
            if how.best and how.per == "group" and how.digits is None and low[at] > worst:
                break
            part = slice(at, at + BATCH)
            dist[part] = warping.distances(x[i[part]], y[j[part]] + shift[part, None], how.warp)
            if how.best and how.per == "group" and np.isfinite(dist).sum() >= how.best:
                worst = np.partition(dist, how.best - 1)[how.best - 1]
        keep = np.flatnonzero(within(dist, how.bound) if np.isfinite(how.bound) else np.isfinite(dist))
        by = blocks.rounded(np.sqrt(dist[keep]) if how.root else dist[keep], how.digits)
        order = keep[np.lexsort((right["sub_id"][j[keep]], right["rec_id"][j[keep]], left["sub_id"][i[keep]], by))]
        if how.best and how.per == "group":
            order = order[: how.best]
        elif how.best:
            owner = i[order]
            by = np.argsort(owner, kind="stable")
            place = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
            order = order[by[place < how.best]]
        i, j = i[order], j[order]
        columns = [left["rec_id"][i], left["sub_id"][i], right["rec_id"][j], right["sub_id"][j], left["s_time"][i], left["e_time"][i], right["s_time"][j], right["e_time"][j], dist[order]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return run


def compared_pairs(left: DataFrame, right: DataFrame | None, how: Compare, *, within: bool = True, block: int = BLOCK) -> DataFrame:
    """Pairs of subsequences (rec_id, sub_id, s_time, e_time, data) with their distances.

    ``within``: only pairs of one recording; otherwise all recordings are compared with all. ``right`` None: a self join.
    """
    if right is None and how.plain and how.self_join and how.warp.band == 0 and (how.best is None or how.per == "group"):
        return blocks.pairs(left, bound=how.bound, inclusive=how.inclusive, best=how.best, digits=how.digits, root=how.root, within=within, fields=FIELDS, schema=_ARROW)
    if right is None:
        right = left
    need = ["rec_id", "sub_id", "s_time", "e_time", "data"]
    one = F.col("rec_id") if within else F.lit(0).cast("long")

    def blocked(rows: DataFrame, other: DataFrame, mine: int) -> DataFrame:
        """Each row once for each block of the other side."""
        cells = lambda t: t.groupBy(one.alias("part")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n"))
        own, its = cells(rows), cells(other).withColumnRenamed("n", "m")
        placed = rows.select(*need, one.alias("part")).join(own, "part").join(its, "part")
        placed = placed.withColumn("mine", F.pmod(F.xxhash64("rec_id", "sub_id"), F.col("n"))).withColumn("its", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
        a, b = ("mine", "its") if mine == 0 else ("its", "mine")
        return placed.select(*need, "part", F.col(a).alias("a"), F.col(b).alias("b"), F.lit(mine).alias("side"))

    rows = blocked(left, right, 0).unionByName(blocked(right, left, 1))
    return rows.groupBy("part", "a", "b").applyInArrow(_compared(how), FIELDS)


def best_pair(windows: DataFrame, warp: Warp) -> DataFrame:
    """The closest pair of subsequences of each recording that don't overlap; ties go to the smaller sub_ids."""
    found = compared_pairs(windows, None, Compare(warp=warp, best=1, self_join=True))
    order = W.partitionBy("l_rec").orderBy("dist", "l_sub", "r_sub")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1).drop("rank")


def nearest(queries: DataFrame, candidates: DataFrame | None, k: int, how: Compare, *, within: bool = False) -> DataFrame:
    """The ``k`` nearest candidates of every query subsequence, with their rank."""
    if candidates is None and how.plain and not how.self_join and not np.isfinite(how.bound):
        return blocks.nearest(queries, k, how.warp, exclude_equal=how.exclude_equal, digits=how.digits, within=within, fields=FIELDS, schema=_ARROW)
    found = compared_pairs(queries, candidates, replace(how, best=k, per="left"), within=within)
    by = F.col("dist") if not how.root else F.sqrt("dist")
    order = W.partitionBy("l_rec", "l_sub").orderBy(by if how.digits is None else F.round(by, how.digits), "r_rec", "r_sub")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def range_join(left: DataFrame, right: DataFrame | None, threshold: float, how: Compare, *, within: bool = False) -> DataFrame:
    """All pairs with a distance below ``threshold``."""
    return compared_pairs(left, right, replace(how, bound=threshold, best=None), within=within)


def _clash(a: tuple, b: tuple) -> bool:
    """Whether any subsequence of one pair overlaps any of the other."""
    return any((x[1] - y[0]) * (y[1] - x[0]) > 0 for x in a for y in b)


def greedy(pairs: list[tuple[float, tuple, tuple, int]], k: int) -> list[int]:
    """Rows of the best ``k`` pairs that overlap none taken before; pairs are (distance, interval, interval, row)."""
    taken: list[tuple] = []
    out = []
    for _, a, b, row in pairs:
        if len(out) == k:
            break
        if not any(_clash((a, b), t) for t in taken):
            taken.append((a, b))
            out.append(row)
    return out


def bounded_queue(pairs: list[tuple[float, tuple, tuple, int]], k: int) -> list[int]:
    """Rows left in a queue of ``k`` slots that pairs enter in the order they are met.

    A pair is put before the first slot with a greater distance, unless it overlaps a slot before that one. The first slot
    it overlaps is given up for it; without one, the last slot is. So what stays hangs on the order.
    """
    slots: list[tuple[float, tuple, int]] = []
    for dist, a, b, row in pairs:
        place = match = None
        for s, (other, both, _) in enumerate(slots):
            if place is None and other > dist:
                place = s
            if _clash((a, b), both):
                match = s
                break
        if place is None and match is None and len(slots) < k:
            place = len(slots)
        if place is None:
            continue
        if match is not None:
            slots.pop(match)
        slots.insert(place, (dist, (a, b), row))
        del slots[k:]
    return [row for _, _, row in slots]


def _chosen(k: int, mode: str):
    def run(rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_pylist()
        every = list(zip(get("dist"), zip(get("l_s"), get("l_e"), strict=True), zip(get("r_s"), get("r_e"), strict=True), range(len(rows)), strict=True))
        l_sub, r_sub = get("l_sub"), get("r_sub")
        if mode == "nms":
            picked = greedy(sorted(every, key=lambda p: (p[0], l_sub[p[3]], r_sub[p[3]])), k)
        else:
            picked = bounded_queue(sorted(every, key=lambda p: (l_sub[p[3]], r_sub[p[3]])), k)
        out = rows.take(pa.array(picked, pa.int64()))
        return out.append_column("rank", pa.array(range(1, len(picked) + 1), pa.int32()))

    return run


def motif_discovery(windows: DataFrame, k: int, warp: Warp, *, mode: str = "ref", bound: float = float("inf"), scales: int = 1) -> DataFrame:
    """The ``k`` best pairs of each recording that don't overlap, with distances below ``bound``.

    mode 'ref' fills a bounded queue in the order of (l_sub, r_sub), which is what the pairs' discoverer does; 'nms' takes
    pairs from the best on if they overlap none taken. Both keep every slot below ``bound`` whatever lies above it, so a
    bound that leaves ``k`` slots filled changes nothing.
    """
    if mode not in ("ref", "nms"):
        raise ValueError("mode is 'ref' or 'nms'")
    pairs = compared_pairs(windows, None, Compare(warp=warp, bound=bound, self_join=True, scales=scales))
    return pairs.groupBy("l_rec").applyInArrow(_chosen(k, mode), FIELDS + ", rank int")


def refine(pairs: DataFrame, left: DataFrame, right: DataFrame, warps: dict[str, Warp]) -> DataFrame:
    """Further distances of given pairs, a column for each name."""
    a = left.select(F.col("rec_id").alias("l_rec"), F.col("sub_id").alias("l_sub"), F.col("data").alias("x"))
    b = right.select(F.col("rec_id").alias("r_rec"), F.col("sub_id").alias("r_sub"), F.col("data").alias("y"))
    joined = pairs.join(a, ["l_rec", "l_sub"]).join(b, ["r_rec", "r_sub"])
    for name, warp in warps.items():
        joined = joined.withColumn(name, pair_distance(F.col("x"), F.col("y"), warp))
    return joined.drop("x", "y")


def pair_distance(x: Column, y: Column, warp: Warp) -> Column:
    """Warping distance of two sequences of a row, in Arrow batches; rows of equal lengths are computed together."""

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        sizes = np.stack([pa.compute.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in (a, b)], axis=1)
        for n, m in np.unique(sizes, axis=0).tolist():
            rows = np.flatnonzero((sizes == (n, m)).all(axis=1))
            if n and m:
                u, v = (c.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in (a, b))
                for at in range(0, len(rows), BATCH):
                    out[rows[at : at + BATCH]] = warping.distances(u[at : at + BATCH], v[at : at + BATCH], warp)
        return pa.array(out, from_pandas=True)

    return distance(x, y)


def path_length(x: Column, y: Column, warp: Warp) -> Column:
    """Cells of the best warping path of two sequences of a row."""

    @F.arrow_udf("int")
    def length(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for u, v in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if not u or not v:
                out.append(None)
                continue
            costs = warping.matrices(np.array([u]), np.array([v]), warp)
            _, i, j = warping.ends(costs, warp)
            out.append(len(warping.path(costs[:, :, 0], (int(i[0]), int(j[0])), warp)))
        return pa.array(out, pa.int32())

    return length(x, y)


def remove_overlap(patterns: DataFrame, tick: float = 0.01) -> DataFrame:
    """Which patterns (rec_id, id, s_time, e_time, dist) overlap a better one of their recording: the column ``black``.

    Patterns are taken by ascending distance, then by id; one that shares a tick (ends included) with one taken is black.
    """

    def run(rows: pa.Table) -> pa.Table:
        s, e = (np.asarray(rows.column(c).to_numpy(), np.float32) for c in ("s_time", "e_time"))
        lo, hi = np.floor(s / np.float32(tick)).astype(np.int64), np.floor(e / np.float32(tick)).astype(np.int64)
        order = np.lexsort((rows.column("id").to_numpy(), rows.column("dist").to_numpy()))
        used = np.zeros(int(hi.max(initial=0)) + 2, bool)
        black = np.zeros(len(lo), bool)
        for r in order.tolist():
            span = slice(int(lo[r]), int(hi[r]) + 1)
            if used[span].any():
                black[r] = True
            else:
                used[span] = True
        return pa.table({"rec_id": rows.column("rec_id"), "id": rows.column("id"), "black": pa.array(black)})

    rows = patterns.select(F.col("rec_id").cast("long").alias("rec_id"), F.col("id").cast("long").alias("id"), F.col("s_time").cast("double").alias("s_time"), F.col("e_time").cast("double").alias("e_time"), F.col("dist").cast("double").alias("dist"))
    return rows.groupBy("rec_id").applyInArrow(run, "rec_id long, id long, black boolean")
