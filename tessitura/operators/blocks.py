"""Sequences of one length in blocks, each block compared with every other without a shuffle of pairs or of copies.

A block is written once, to a file of the shared folder, and read by the tasks that need it. Equal sequences lie in one block
and are compared once: it holds distinct sequences, each with those of its members that can count, and apart from them all
members. Inside a task a matrix product or a warping, both in single precision, tells which pairs can count, with a margin
for its rounding errors; only those get their distance in double precision, by the same kernel as everywhere.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import warping
from ..functions.warping import Warp
from . import lineage

#: Most distinct sequences of a block on average, rows of a tile, pairs warped at once in double and in single precision.
SIZE, TILE, BATCH, WARPED = 2048, 256, 4096, 16384
#: Most values of a block with all its members, member pairs made at once.
VALUES, MADE = 1 << 22, 1 << 18
COLUMNS = ["rec_id", "sub_id", "s_time", "e_time", "data"]
KEYS = COLUMNS[:4]


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith(("file:", "/")):
        return pyarrow.fs.LocalFileSystem(), re.sub("^(file:)?/*", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder))


def put(folder: str, table: pa.Table) -> str:
    """Write a block; its name is new for each attempt."""
    system, path = _files(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex
    with system.open_output_stream(f"{path}/{name}", compression=None) as out, pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return name


def get(folder: str, name: str) -> pa.Table:
    system, path = _files(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as source:
        return pa.ipc.open_stream(source).read_all()


def block_size(rows: int, blocks: int = 24) -> int:
    """Rows of a block, so that a small table still makes a few dozen tasks."""
    return min(SIZE, max(64, -(-rows // blocks)))


def side(rows: pa.Table) -> dict[str, np.ndarray]:
    out = {c: rows.column(c).to_numpy() for c in ("rec_id", "sub_id", "s_time", "e_time")}
    data = rows.column("data").combine_chunks()
    sizes = pa.compute.list_value_length(data).to_numpy(zero_copy_only=False)
    if len(np.unique(sizes)) > 1:
        raise ValueError("sequences have one length")
    out["data"] = data.flatten().to_numpy(zero_copy_only=False).reshape(len(data), -1) if len(data) else np.zeros((0, 0))
    return out


def _first(rep: np.ndarray, rec: np.ndarray, sub: np.ndarray, most: int) -> np.ndarray:
    """Of members in the order of sequence and key, those of the first ``most`` keys of a sequence, a key so often at most."""
    new = np.r_[True, rep[1:] != rep[:-1]]
    fresh = new | np.r_[True, (rec[1:] != rec[:-1]) | (sub[1:] != sub[:-1])]
    key, at = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    return (key - key[new][rep] < most) & (np.arange(len(rep)) - at[key] < most)


def spooled(rows: DataFrame, within: bool, most: int | None) -> tuple[str, list[list[tuple[str, str]]]]:
    """Folder and names of blocks, listed by cell: blocks of a cell are compared with each other.

    All rows are one cell, or with ``within`` the rows of a recording; recordings that fit in a block share blocks, each a
    cell of its own. Sequences with a value that is null or not finite have no distance and are left out. A block is two
    files: distinct sequences (with ``within`` of a recording) with the first ``most`` members of each, and all members.
    """
    folder = f"{lineage.shared_folder(rows.sparkSession)}/tessitura/blocks-{uuid.uuid4().hex}"
    part = F.col("rec_id") if within else F.lit(0).cast("long")
    rows = rows.select(*COLUMNS, part.alias("_part"), F.xxhash64("data").alias("_hash"))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.approx_count_distinct("_hash").alias("_d"), F.max(F.size("data")).alias("_length"))
    total, distinct, length, parts = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_d"), F.lit(0)), F.coalesce(F.max("_length"), F.lit(1)), F.count(F.lit(1))).first()
    size, full = block_size(distinct), max(64, VALUES // max(1, length))
    if not within:
        placed = rows.withColumn("_n", F.lit(total)).withColumn("_d", F.lit(distinct))
    else:
        placed = rows.join(F.broadcast(counts) if parts <= 1 << 14 else counts, "_part")
    small = (F.col("_d") <= size) & (2 * F.col("_n") <= full) & F.lit(within)
    shared = F.pmod(F.xxhash64("_part"), F.lit(max(1, -(-distinct // size), -(-2 * total // full))))
    own = F.pmod("_hash", F.greatest(F.ceil(F.col("_d") / size), F.ceil(2 * F.col("_n") / full)))
    placed = placed.select(*COLUMNS, small.alias("_small"), F.when(small, shared).otherwise(F.col("_part")).alias("_cell"), F.when(small, 0).otherwise(own).cast("long").alias("_number"))
    # Sequences of very many members are dealt out; what is compared twice for it are their few distinct ones.
    large = placed.groupBy("_small", "_cell", "_number").agg(F.ceil(F.count(F.lit(1)) / full).alias("_times")).where("_times > 1 AND NOT _small")
    placed = placed.join(F.broadcast(large), ["_small", "_cell", "_number"], "left")
    placed = placed.withColumn("_turn", F.when(F.col("_times").isNull(), 0).otherwise(F.pmod(F.xxhash64("rec_id", "sub_id"), F.col("_times"))).cast("long")).drop("_times")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = side(table.select(COLUMNS))
        fine = np.isfinite(found["data"]).all(axis=1)
        found = {c: v[fine] for c, v in found.items()}
        data, n, names = np.ascontiguousarray(found["data"] + 0.0, np.float64), 0, ["", ""]
        if len(data):
            what = np.column_stack([found["rec_id"] if within else np.zeros(len(data), np.int64), data.view(np.int64)])
            _, at, rep = np.unique(np.ascontiguousarray(what).view(np.dtype((np.void, 8 * what.shape[1]))).ravel(), return_index=True, return_inverse=True)
            order = np.lexsort((found["sub_id"], found["rec_id"], rep))
            n, rep, members = len(at), rep[order], {c: found[c][order] for c in KEYS}
            kept = np.ones(len(rep), bool) if most is None else _first(rep, members["rec_id"], members["sub_id"], most)
            starts = np.r_[0, np.cumsum(np.bincount(rep[kept], minlength=n))].astype(np.int32)
            ends = (np.arange(n + 1) * data.shape[1]).astype(np.int32)
            lists = {c: pa.ListArray.from_arrays(starts, pa.array(v[kept])) for c, v in members.items()}
            names = [put(folder, pa.table({"data": pa.ListArray.from_arrays(ends, data[at].ravel()), "copies": np.bincount(rep), **lists})), put(folder, pa.table({"rep": rep, **members}))]
        values = [key[0].as_py(), key[1].as_py(), key[2].as_py(), key[3].as_py(), n, *names]
        return pa.table([pa.array([v], t) for v, t in zip(values, (pa.bool_(), *[pa.int64()] * 4, pa.string(), pa.string()), strict=True)], names=["small", "cell", "number", "turn", "rows", "name", "members"])

    cells: dict[tuple, list] = {}
    for r in placed.groupBy("_small", "_cell", "_number", "_turn").applyInArrow(run, "small boolean, cell long, number long, turn long, rows long, name string, members string").collect():
        if r.rows:
            cells.setdefault((r.small, r.cell), []).append((r.number, r.turn, r.name, r.members))
    return folder, [[(name, members) for _, _, name, members in sorted(found)] for _, found in sorted(cells.items())]


def distinct(folder: str, name: str) -> dict[str, np.ndarray]:
    """Distinct sequences of a block; the members kept of sequence k are those from start[k] to start[k + 1]."""
    rows = get(folder, name)
    lists = {c: rows.column(c).combine_chunks() for c in ("data", *KEYS)}
    out = {c: v.flatten().to_numpy() for c, v in lists.items()}
    out["data"] = out["data"].reshape(len(rows), -1)
    out["start"] = np.r_[0, np.cumsum(pa.compute.list_value_length(lists["rec_id"]).to_numpy())]
    out["copies"] = rows.column("copies").to_numpy()
    return out


class Best:
    """The ``k`` best partners of each of ``m`` sequences, by distance (rounded, if ``digits``) and then by key."""

    def __init__(self, m: int, k: int, digits: int | None) -> None:
        self.k, self.digits = k, digits
        self.owner, self.rows = np.zeros(0, np.int64), {c: np.zeros(0, t) for c, t in _PARTNER.items()}
        self.worst = np.full(m, np.inf)

    def put(self, owner: np.ndarray, partner: dict[str, np.ndarray], dist: np.ndarray) -> None:
        fine = np.isfinite(dist)
        fresh = {c: partner[c][fine] for c in ("rec_id", "sub_id", "s_time", "e_time")} | {"dist": dist[fine], "rank_by": rounded(dist[fine], self.digits)}
        owner = np.r_[self.owner, owner[fine]]
        rows = {c: np.r_[self.rows[c], fresh[c]] for c in _PARTNER}
        order = np.lexsort((rows["sub_id"], rows["rec_id"], rows["rank_by"], owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        keep = place < self.k
        self.owner, self.rows, self.place = owner[keep], {c: v[order[keep]] for c, v in rows.items()}, place[keep]
        last = self.place == self.k - 1
        self.worst[self.owner[last]] = self.rows["rank_by"][last]

    def limits(self) -> np.ndarray:
        """Distances up to which a further partner can count."""
        return self.worst if self.digits is None else self.worst + 10.0**-self.digits


_PARTNER = {"rec_id": np.int64, "sub_id": np.int64, "s_time": np.float64, "e_time": np.float64, "dist": np.float64, "rank_by": np.float64}


def rounded(dist: np.ndarray, digits: int | None) -> np.ndarray:
    """Distances rounded half away from zero, as SQL does."""
    return dist if digits is None else np.floor(dist * 10.0**digits + 0.5) / 10.0**digits


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, warp: Warp) -> np.ndarray:
    out = np.zeros(len(i))
    for at in range(0, len(i), BATCH):
        part = slice(at, at + BATCH)
        out[part] = warping.distances(x[i[part]], y[j[part]], warp)
    return out


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared Euclidean distances of all pairs, and what they may be off by."""
    qx, qy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    out = x @ y.T
    out *= -2.0
    out += qx[:, None]
    out += qy
    return out, 1e-15 * (x.shape[1] + 8) * float(qx.max(initial=0) + qy.max(initial=0))


def _within(x: np.ndarray, y: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose squared Euclidean distance may be up to the limit of their left row, from a product in single precision."""
    centre = x.mean(axis=0)
    a, b = x - centre, y - centre
    qa, qb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    if max(qa.max(initial=0), qb.max(initial=0)) < 1e30:
        off = 1e-7 * (x.shape[1] + 8) * (2 * (qa + qb.max(initial=0)) + limits)
        one, two = np.empty((len(a), a.shape[1] + 2), np.float32), np.empty((len(b), b.shape[1] + 2), np.float32)
        one[:, :-2], one[:, -2], one[:, -1] = -2.0 * a, np.clip(qa - limits - off, -3e38, 3e38), 1.0
        two[:, :-2], two[:, -2], two[:, -1] = b, 1.0, qb
        i, j = np.divmod(np.flatnonzero(one @ two.T <= 0.0), len(y))
        if len(i) <= 16 * len(x):
            return i, j
    square, off = _squares(x, y)
    return np.nonzero(square <= limits[:, None] + off)


def _limits32(limits: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Limits in single precision: the root of a path's cost is off by the root of its cells times a value's error."""
    off = 2.4e-7 * max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    return np.minimum(np.square(np.sqrt(limits) * (1 + 1e-5 + 1e-7 * x.shape[1]) + np.sqrt(2 * x.shape[1]) * off) * (1 + 1e-6), 3e38).astype(np.float32)


def _corners(xt: np.ndarray, yt: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the last two cells of a path cost at least."""
    a, b, c, d = xt[-1].take(i), yt[-1].take(j), xt[-2].take(i), yt[-2].take(j)
    return np.square(a - b) + np.minimum(np.minimum(np.square(c - b), np.square(a - d)), np.square(c - d))


def _possible(xt: np.ndarray, yt: np.ndarray, i: np.ndarray, j: np.ndarray, limits: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose warping distance in single precision is up to the limit of their left sequence.

    Costs grow row by row; after some rows the pairs go whose cheapest cell, with the path's end, is above the limit.
    """
    n, kind = len(xt), xt.dtype
    limit, end = limits.take(i), _corners(xt, yt, i, j)
    ys, known = np.empty((n, len(i)), kind), 0
    # Costs of column c are in row c + 1; what lies outside the band is infinite.
    before, now = np.full((n + 1, len(i)), np.inf, kind), np.full((n + 1, len(i)), np.inf, kind)
    before[0] = 0.0
    for r in range(n):
        lo, hi = max(0, r - band), min(n, r + band + 1)
        for c in range(known, hi):
            yt[c].take(j, out=ys[c], mode="clip")
        known = hi
        cost = xt[r].take(i) - ys[lo:hi]
        cost *= cost
        least = np.minimum(before[lo:hi], before[lo + 1 : hi + 1])
        np.add(cost[0], least[0], out=now[lo + 1])
        for c in range(lo + 1, hi):
            np.minimum(least[c - lo], now[c], out=least[c - lo])
            np.add(cost[c - lo], least[c - lo], out=now[c + 1])
        before, now = now, before
        now[0] = np.inf
        if r < n - 1 and (r % 2 == 0 or r >= n - 2):
            continue
        keep = before[n] <= limit if r == n - 1 else before[lo + 1 : hi + 1].min(axis=0) + end <= limit
        if r == n - 1 or np.count_nonzero(keep) < 0.8 * len(keep):
            at = np.flatnonzero(keep)
            i, j, limit, end = i[at], j[at], limit[at], end[at]
            if not len(at) or r == n - 1:
                break
            kept, seen = before[lo + 1 : hi + 1].take(at, axis=1), ys[lo:hi].take(at, axis=1)
            ys = np.empty((n, len(at)), kind)
            before, now = np.full((n + 1, len(at)), np.inf, kind), np.full((n + 1, len(at)), np.inf, kind)
            before[lo + 1 : hi + 1], ys[lo:hi] = kept, seen
    return i, j


def _warpable(x: np.ndarray, y: np.ndarray, skip: np.ndarray | None, limits: np.ndarray, band: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may be within the limits of the left rows, by the ends of their paths and then by warping."""
    kind = np.float32 if max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15 else np.float64
    xt, yt = np.ascontiguousarray(x.T, kind), np.ascontiguousarray(y.T, kind)
    limit = _limits32(limits, x, y) if kind is np.float32 else limits * (1 + 1e-9)
    for at in range(0, len(x), 64):
        part = slice(at, at + 64)
        low = np.square(xt[0, part, None] - yt[0]) + np.square(xt[-1, part, None] - yt[-1])
        for p, q in ((0, 1), (-1, -2)):
            near = np.square(xt[p, part, None] - yt[q])
            np.minimum(near, np.square(xt[q, part, None] - yt[p]), out=near)
            np.minimum(near, np.square(xt[q, part, None] - yt[q]), out=near)
            low += near
        keep = low <= limit[part, None]
        if skip is not None:
            keep &= ~skip[part]
        i, j = np.divmod(np.flatnonzero(keep), len(y))
        i += at
        for to in range(0, len(i), WARPED):
            yield _possible(xt, yt, i[to : to + WARPED], j[to : to + WARPED], limit, band)


def _apart(left: dict, right: dict, tile: slice, within: bool) -> np.ndarray | None:
    """Pairs of different recordings in a block that these share, which don't count."""
    return left["rec_id"][left["start"][:-1]][tile, None] != right["rec_id"][right["start"][:-1]] if within else None


def _members(right: dict, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Left rows, right members and distances of pairs."""
    n = np.diff(right["start"])[j]
    at = np.repeat(np.arange(len(j)), n)
    p = np.arange(len(at)) - (np.cumsum(n) - n - right["start"][j])[at]
    return i[at], {c: right[c][p] for c in KEYS}, dist[at]


def _nearest_of(left: dict, rights: Iterator[dict], k: int, warp: Warp, digits: int | None, within: bool) -> Best:
    """Partners of the left block's distinct sequences, themselves included; the first of the right blocks is the left one."""
    m, x = len(left["copies"]), left["data"]
    best, band, found = Best(m, k, digits), x.shape[1] if warp.band is None else warp.band, []
    for first, right in enumerate(rights):
        y = right["data"]
        for at in range(0, m, TILE):
            tile, skip = slice(at, min(m, at + TILE)), None
            if not first:
                # A warping distance is at most the Euclidean one: the nearest by that give limits to begin with.
                square, _ = _squares(x[tile], y)
                skip = _apart(left, right, tile, within)
                if skip is not None:
                    square[skip] = np.inf
                some = min(len(y), 4 * k if band else k)
                i = np.repeat(np.arange(len(square)), some)
                j = np.argpartition(square, some - 1, axis=1)[:, :some].ravel()
                if skip is not None:
                    i, j = i[~skip[i, j]], j[~skip[i, j]]
                seeds = Best(m, k, digits)
                seeds.put(*_members(right, i + at, j, _exact(x[tile], y, i, j, warp)))
                best.worst[tile] = seeds.worst[tile]
            limits = best.limits()[tile]
            if not band:
                near = [_within(x[tile], y, limits)]
            elif x.shape[1] < 4:
                near = [np.nonzero(np.ones((len(limits), len(y)), bool))]
            else:
                near = _warpable(x[tile], y, skip, limits, band)
            for i, j in near:
                if skip is not None:
                    i, j = i[~skip[i, j]], j[~skip[i, j]]
                if len(i):
                    found.append(_members(right, i + at, j, _exact(x[tile], y, i, j, warp)))
            if found and (at + TILE >= m or sum(len(f[0]) for f in found) >= 1 << 18):
                best.put(np.concatenate([f[0] for f in found]), {c: np.concatenate([f[1][c] for f in found]) for c in KEYS}, np.concatenate([f[2] for f in found]))
                found = []
    return best


def _ranked(best: Best, members: pa.Table, k: int, exclude_equal: bool) -> Iterator[list[np.ndarray]]:
    """The first ``k`` partners of each member, itself left out with ``exclude_equal``; partners are listed by sequence."""
    start = np.searchsorted(best.owner, np.arange(len(best.worst) + 1))
    for at in range(0, len(members), MADE // (best.k + 1) + 1):
        part = members.slice(at, MADE // (best.k + 1) + 1)
        rep, mine = part.column("rep").to_numpy(), {c: part.column(c).to_numpy() for c in KEYS}
        n = (start[1:] - start[:-1])[rep]
        i = np.repeat(np.arange(len(rep)), n)
        p = np.arange(len(i)) - (np.cumsum(n) - n - start[rep])[i]
        if exclude_equal:
            other = (mine["rec_id"][i] != best.rows["rec_id"][p]) | (mine["sub_id"][i] != best.rows["sub_id"][p])
            i, p = i[other], p[other]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        i, p, rank = i[rank <= k], p[rank <= k], rank[rank <= k]
        yield [mine["rec_id"][i], mine["sub_id"][i], best.rows["rec_id"][p], best.rows["sub_id"][p], mine["s_time"][i], mine["e_time"][i], best.rows["s_time"][p], best.rows["e_time"][p], best.rows["dist"][p], rank]


def _batch(columns: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def nearest(rows: DataFrame, k: int, warp: Warp, *, exclude_equal: bool, digits: int | None, within: bool, fields: str, schema: pa.Schema) -> DataFrame:
    """The ``k`` nearest sequences of each, with their rank: a task has some left blocks and reads all blocks of their cell."""
    # A sequence finds itself too, as often as its key is there.
    often = (rows.groupBy("rec_id", "sub_id").count().agg(F.max("count")).first()[0] or 0) if exclude_equal else 0
    folder, cells = spooled(rows, within, k + often)
    tasks = [(at, cell) for cell, names in enumerate(cells) for at in range(len(names))]
    schema = schema.append(pa.field("rank", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                start, cell = tasks[t]
                order = cells[cell][start:] + cells[cell][:start]
                best = _nearest_of(distinct(folder, order[0][0]), (distinct(folder, name) for name, _ in order), k + often, warp, digits, within)
                for columns in _ranked(best, get(folder, order[0][1]), k, exclude_equal):
                    yield _batch(columns, schema)

    return lineage.tasks(rows.sparkSession, len(tasks)).mapInArrow(run, fields + ", rank int")


def _near(left: dict, right: dict, at: int, high: float, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile of the left block with their distances up to ``high``; of a block with itself each pair once."""
    tile = slice(at, at + TILE)
    i, j = _within(left["data"][tile], right["data"], np.full(len(left["data"][tile]), high))
    i = i + at
    if left is right:
        i, j = i[i < j], j[i < j]
        if within:
            one = left["rec_id"][left["start"][:-1]]
            i, j = i[one[i] == one[j]], j[one[i] == one[j]]
    dist = _exact(left["data"], right["data"], i, j, Warp(band=0))
    keep = np.isfinite(dist) & (dist <= high)
    return i[keep], j[keep], dist[keep]


def _products(left: dict, right: dict, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pairs of members, the smaller key on the left."""
    n, m = np.diff(left["start"])[i], np.diff(right["start"])[j]
    ends = np.cumsum(n * m)
    for at in range(0, int(ends[-1]) if len(ends) else 0, MADE):
        flat = np.arange(at, min(int(ends[-1]), at + MADE))
        pair = np.searchsorted(ends, flat, side="right")
        p, q = np.divmod(flat - (ends - n * m)[pair], m[pair])
        p, q = p + left["start"][i[pair]], q + right["start"][j[pair]]
        below = (left["rec_id"][p] < right["rec_id"][q]) | ((left["rec_id"][p] == right["rec_id"][q]) & (left["sub_id"][p] < right["sub_id"][q]))
        above = (left["rec_id"][p] > right["rec_id"][q]) | ((left["rec_id"][p] == right["rec_id"][q]) & (left["sub_id"][p] > right["sub_id"][q]))
        if left is right:
            above &= i[pair] != j[pair]
        keep = below | above
        p, q, swap, far = p[keep], q[keep], above[keep], dist[pair[keep]]
        one, two = ([np.where(swap, v[c][b], u[c][a]) for c in KEYS] for u, a, v, b in ((left, p, right, q), (right, q, left, p)))
        yield [one[0], one[1], two[0], two[1], one[2], one[3], two[2], two[3], far]


def pairs(rows: DataFrame, *, bound: float, inclusive: bool, best: int | None, digits: int | None, root: bool, within: bool, fields: str, schema: pa.Schema) -> DataFrame:
    """Pairs (left key below right key) with squared Euclidean distances within ``bound``, or the ``best`` so many of a task.

    The best are chosen by the distance, or with ``root`` by its root, rounded if ``digits``, and then by their keys; of
    equal sequences the first best + 1 keys can be among them, as each further one has as many partners before it.
    """
    folder, cells = spooled(rows, within, best + 1 if best else None)
    if best:
        tasks = [(name, [other for other, _ in names[at:]]) for names in cells for at, (name, _) in enumerate(names)]
    else:
        tasks = [(name, [other]) for names in cells for at, (name, _) in enumerate(names) for other, _ in names[at:]]

    def by(dist: np.ndarray) -> np.ndarray:
        return rounded(np.sqrt(dist) if root else dist, digits)

    def highest(worst: float) -> float:
        high = worst + (10.0**-digits if digits is not None else 0.0)
        return high * high * (1 + 1e-12) if root else high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                name, others = tasks[t]
                left, kept, worst = distinct(folder, name), [], np.inf
                for other in others:
                    right = left if other == name else distinct(folder, other)
                    for at in range(0, len(left["copies"]), TILE):
                        high = min(bound, highest(worst)) if best else bound
                        if best and not np.isfinite(worst):
                            square, off = _squares(left["data"][at : at + TILE], right["data"])
                            if right is left:
                                square[np.tri(*square.shape, at, dtype=bool)] = np.nan
                                if within:
                                    square[_apart(left, right, slice(at, at + TILE), within)] = np.nan
                            flat = square[np.isfinite(square)]
                            if len(flat) > best:
                                high = min(bound, highest(by(max(0.0, np.partition(flat, best - 1)[best - 1] + off))))
                        i, j, dist = _near(left, right, at, high, within)
                        if right is left:
                            alike = at + np.flatnonzero(left["copies"][at : at + TILE] > 1)
                            i, j, dist = np.r_[i, alike], np.r_[j, alike], np.r_[dist, np.zeros(len(alike))]
                        ok = dist <= bound if inclusive or not np.isfinite(bound) else dist < bound
                        for columns in _products(left, right, i[ok], j[ok], dist[ok]):
                            if not best:
                                for to in range(0, len(columns[0]), 1 << 16):
                                    yield _batch([c[to : to + (1 << 16)] for c in columns], schema)
                                continue
                            kept = columns if not kept else [np.r_[u, v] for u, v in zip(kept, columns, strict=True)]
                            order = np.lexsort((kept[3], kept[2], kept[1], kept[0], by(kept[8])))[:best]
                            kept = [c[order] for c in kept]
                            worst = by(kept[8])[-1] if len(kept[8]) == best else np.inf
                if kept:
                    yield _batch(kept, schema)

    return lineage.tasks(rows.sparkSession, len(tasks)).mapInArrow(run, fields)


def group_pairs(rows: DataFrame, *, bound: float, within: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of groups of equal sequences (p, q, their members n_p and n_q) with squared Euclidean distances up to ``bound``,
    each once and none with itself, and the members (group, rec_id, sub_id). Very many equal sequences are several groups."""
    folder, cells = spooled(rows, within, 1)
    names = [name for cell in cells for name in cell]
    number = {name: at for at, (name, _) in enumerate(names)}
    work = [(name, other) for cell in cells for at, (name, _) in enumerate(cell) for other, _ in cell[at:]]
    found = pa.schema([(c, pa.int64()) for c in ("p", "q", "n_p", "n_q")] + [("dist", pa.float64())])
    member = pa.schema([(c, pa.int64()) for c in ("group", "rec_id", "sub_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                name, other = work[t]
                left = distinct(folder, name)
                right = left if other == name else distinct(folder, other)
                for at in range(0, len(left["copies"]), TILE):
                    i, j, dist = _near(left, right, at, bound, within)
                    yield _batch([i + (number[name] << 32), j + (number[other] << 32), left["copies"][i], right["copies"][j], dist], found)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                members = get(folder, names[t][1])
                yield _batch([members.column("rep").to_numpy() + (t << 32), *[members.column(c).to_numpy() for c in ("rec_id", "sub_id")]], member)

    spark = rows.sparkSession
    pairs = lineage.tasks(spark, len(work)).mapInArrow(run, "p long, q long, n_p long, n_q long, dist double")
    return pairs, lineage.tasks(spark, len(names)).mapInArrow(listed, "group long, rec_id long, sub_id long")
