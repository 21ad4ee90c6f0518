"""Embedding near-dedup by sorted projection passes.

Equal vectors are one class. In each pass a class gets a key of 64 random hyperplane bits; classes of a label are sorted
by it and each is compared with the next WINDOW ones. Verified pairs of all passes are united to components.

Windows are bounded, so a link that no window held would be missing; the more of a label's vectors lie close together, the
more there are. Therefore the classes of a label are compared in full afterwards, in pairs of blocks that are dealt out
over the cluster; links are counted there, not emitted, and only a spanning forest is handed on. That is exact and costs
the square of a label's classes. Without it (``exact=False``) only components that the passes found are compared in full:
that costs what the passes cost, and what can be missed is a component, or a link between two, that no window held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forest, materialize, partitions
from .components import connected_components

PASSES, WINDOW, KEY_BITS = 16, 32, 64
#: Classes that are compared as one block.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # keeps squares of very large and very small components finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _passes(passes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), passes * KEY_BITS))
                mine = batch.filter(pa.array(dims == dim))
                for lo in range(0, len(mine), 2048):
                    part = mine.slice(lo, 2048)
                    bits = _unit(_matrix(part.column("vector"))) @ planes[dim] > 0
                    packed = np.packbits(bits.reshape(len(part), passes, KEY_BITS), axis=2).view(">u8")[:, :, 0].astype(np.uint64)
                    signed = (packed ^ np.uint64(1 << 63)).view(np.int64)
                    for k in range(passes):
                        yield pa.record_batch({"pass": pa.array(np.full(len(part), k, np.int32)), "label": part.column("label"), "dim": part.column("dim"), "key": pa.array(np.ascontiguousarray(signed[:, k])), "id": part.column("id"), "vector": part.column("vector")})

    return run


def _windows(window: int, least: float):
    """Links of a spanning forest among the verified pairs of each run of sorted rows."""

    def links(x: np.ndarray, ids: np.ndarray, group: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for step in range(1, min(window, len(x) - 1) + 1):
            lo = max(0, fresh - step)
            a = np.arange(lo, len(x) - step)
            a = a[group[a] == group[a + step]]
            near = np.einsum("ij,ij->i", x[a], x[a + step]) >= least
            left.append(a[near])
            right.append(a[near] + step)
        a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        moved, root = forest(a, b, len(x))
        return ids[moved], ids[root]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            # Passes, labels and dimensions are told apart by one number each row.
            parts = [batch.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "dim")]
            change = np.flatnonzero(np.r_[True, np.any([p[1:] != p[:-1] for p in parts], axis=0), True]) if len(batch) else [0]
            for lo, hi in zip(change[:-1], change[1:], strict=True):
                tag = (int(parts[0][lo]), int(parts[1][lo]), int(parts[2][lo]))
                piece = batch.slice(lo, hi - lo)
                for at in range(0, len(piece), 4096):
                    part = piece.slice(at, 4096)
                    x, ids = _unit(_matrix(part.column("vector"))), part.column("id").to_numpy()
                    fresh = 0
                    if tail is not None and tail[2] == tag:
                        fresh = len(tail[1])
                        x, ids = np.concatenate([tail[0], x]), np.concatenate([tail[1], ids])
                    a, b = links(x, ids, np.zeros(len(x), np.int8), fresh)
                    tail = (x[-window:], ids[-window:], tag)
                    if len(a):
                        yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _counted(least: float):
    """Links of each class within a pair of blocks, and the least class there it is joined with; rows come sorted by their pair (task key) and side."""

    def count(side: np.ndarray, ids: np.ndarray, x: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
        got = np.zeros(len(ids), np.int64)
        moved = root = np.zeros(0, np.int64)
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1)))
        for lo in range(0, len(left), 512):
            mine = left[lo : lo + 512]
            near = x[mine] @ x[right].T >= least
            if same:
                near[np.arange(len(mine)), lo + np.arange(len(mine))] = False
            got[mine] += near @ n[right]
            a, b = np.nonzero(near)
            moved, root = forest(np.r_[moved, mine[a]], np.r_[root, right[b]], len(ids))
            if not same:
                got[right] += n[mine] @ near
        low = ids.copy()
        low[moved] = ids[root]
        return pa.record_batch({"id": pa.array(ids, pa.int64()), "links": pa.array(got), "low": pa.array(low, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, kept = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if kept:
                rows = pa.Table.from_batches(kept).combine_chunks()
                x = _unit(_matrix(rows.column("vector").combine_chunks()))
                one = lambda c: rows.column(c).to_numpy()
                yield count(one("side"), one("id"), x, one("n"), bool(one("same")[0]))

        for batch in batches:
            tags = batch.column("task").to_numpy()
            change = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1], True]) if len(batch) else [0]
            for lo, hi in zip(change[:-1], change[1:], strict=True):
                if tags[lo] != tag:
                    yield from done()
                    tag, kept = tags[lo], []
                kept.append(batch.slice(lo, hi - lo))
        yield from done()

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, *, passes: int = PASSES, window: int = WINDOW, seed: int = 7, block: int = BLOCK, exact: bool = True) -> DataFrame:
    """Every vector's vec_id, n_links, component_id and kept; vectors link at a cosine of at least ``least``.

    ``vectors`` has vec_id, embedding (array) and label. Only equal, non-null labels and equal lengths are compared.
    Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors of null labels, link with
    nothing and keep themselves; equal vectors link with each other; repeated rows with one vec_id count as vectors of
    their own; an empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"), vectors["label"].cast("long").alias("label"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("vector", lambda v: v != 0)
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True))
    rows = rows.select("*", usable.alias("usable"), F.xxhash64("vector").alias("h"), F.xxhash64(F.lit("second"), "vector").alias("g"))
    good = rows.where("usable")
    classes = materialize(good.groupBy("label", "h", "g").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector")), "classes")
    n = partitions(spark)
    keyed = classes.select("id", "label", "dim", "vector").mapInArrow(_passes(passes, seed), "pass int, label long, dim int, key long, id long, vector array<double>")
    keyed = keyed.repartitionByRange(n, "pass", "label", "dim", "key", "id").sortWithinPartitions("pass", "label", "dim", "key", "id")
    links = keyed.select("pass", "label", "dim", "id", "vector").mapInArrow(_windows(window, least), "a long, b long")
    links = materialize(links, "links")
    if exact:
        grouped = classes.select(F.col("id").alias("node"), F.xxhash64("label", "dim").alias("group"))
    else:
        joined = connected_components(links)
        grouped = joined.select("node", F.col("root").alias("group")).union(joined.select("root", "root").distinct())
    sizes = grouped.groupBy(F.col("group").alias("of")).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    placed = grouped.join(sizes, F.col("group") == F.col("of")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    tasks = placed.select("node", F.xxhash64("group", low, high).alias("task"), (F.col("mine") == F.col("other")).alias("same"), F.when(F.col("mine") == low, 0).otherwise(1).alias("side"))
    full = tasks.join(classes, tasks["node"] == classes["id"]).select("task", "same", "side", "id", "n", "vector")
    dealt = full.repartition(n, "task").sortWithinPartitions("task", "side", "id")
    compared = materialize(dealt.mapInArrow(_counted(least), "id long, links long, low long"), "compared")
    counts = compared.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(links.unionByName(compared.where(F.col("low") != F.col("id")).select(F.col("id").alias("a"), F.col("low").alias("b"))))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = classes.select("label", "h", "g", "id", "n").join(counts, "id", "left").join(members, F.col("id") == F.col("node"), "left")
    known = known.select(F.col("label").alias("l"), F.col("h").alias("hh"), F.col("g").alias("gg"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    same = F.col("usable") & (F.col("label") == F.col("l")) & (F.col("h") == F.col("hh")) & (F.col("g") == F.col("gg"))
    joined = rows.drop("vector").join(known, same, "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
