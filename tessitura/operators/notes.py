"""Operators on notes (rec_id, phrase, s_time, e_time, level), pitch histograms and phase-space surfaces."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import blocks
from .lineage import numbered, shared_folder, stored, tasks

def duration() -> Column:
    return F.col("e_time") - F.col("s_time")


def duration_histogram(notes: DataFrame, width: float, bins: int) -> DataFrame:
    """For each level the share of its notes in each bin of duration; longer notes are in the last bin."""
    at = F.least(F.floor(duration() / F.lit(width)), F.lit(bins - 1)).cast("int")
    counted = notes.groupBy("level", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("level", "bin", "n", (F.col("n") / F.sum("n").over(W.partitionBy("level"))).alias("share"))


def level_histogram(notes: DataFrame, levels: Sequence[int], octave: int | None = None) -> DataFrame:
    """Notes of each level, or of each level of one octave; levels without notes count 0."""
    level = F.col("level") if octave is None else F.pmod(F.col("level"), F.lit(octave))
    counted = notes.groupBy(level.cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    spine = notes.sparkSession.createDataFrame([(int(x),) for x in levels], "level int")
    return spine.join(counted, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def phrase_note_matrix(notes: DataFrame) -> DataFrame:
    """Time of each level in each phrase, over the phrase's longest."""
    total = notes.groupBy("rec_id", "phrase", "level").agg(F.sum(duration()).alias("time"))
    top = F.max("time").over(W.partitionBy("rec_id", "phrase"))
    return total.select("rec_id", "phrase", "level", F.when(top > 0, F.col("time") / top).otherwise(0.0).alias("share"))


def salient_notes(notes: DataFrame, width: int, hop: int) -> DataFrame:
    """The level that sounds longest in each frame of ``width`` phrases, ``hop`` phrases apart; the lowest of equals."""
    first, last = F.ceil((F.col("phrase") - width + 1) / hop), F.floor(F.col("phrase") / hop)
    framed = notes.withColumn("frame", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))
    total = framed.groupBy("rec_id", "frame", "level").agg(F.sum(duration()).alias("time"))
    return total.groupBy("rec_id", "frame").agg(F.max_by("level", F.struct("time", -F.col("level"))).alias("level"))


def phrase_statistics(notes: DataFrame) -> DataFrame:
    """For each phrase: duration, notes, notes a second, onset, longest note and its level."""
    per = notes.groupBy("rec_id", "phrase").agg(F.min("s_time").alias("onset"), (F.max("e_time") - F.min("s_time")).alias("duration"), F.count(F.lit(1)).alias("notes"), F.max(duration()).alias("longest"), F.max_by("level", F.struct(duration().alias("d"), -F.col("level"))).alias("level"))
    return per.withColumn("density", F.when(F.col("duration") > 0, F.col("notes") / F.col("duration")))


def onset_gaps(notes: DataFrame, width: float, bins: int) -> DataFrame:
    """Histogram of the gaps between the onsets of neighbouring notes; longer gaps are in the last bin."""
    gap = F.col("s_time") - F.lag("s_time").over(W.partitionBy("rec_id").orderBy("s_time", "level"))
    gaps = notes.select(gap.alias("gap")).where(F.col("gap").isNotNull())
    rows = gaps.select(F.least(F.floor(F.col("gap") / F.lit(width)), F.lit(bins - 1)).cast("int").alias("bin"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def notes_in_phrases(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """Notes that lie wholly in a phrase (rec_id, phrase, start, end) of their recording."""
    s = spans.select(F.col("rec_id").alias("p_rec"), F.col("phrase").alias("p_phrase"), "start", "end")
    inside = (F.col("rec_id") == F.col("p_rec")) & (F.col("s_time") >= F.col("start")) & (F.col("e_time") <= F.col("end"))
    return notes.join(s, inside).groupBy("rec_id", F.col("p_phrase").alias("phrase")).agg(F.count(F.lit(1)).alias("notes"))


def fuzzy_beat(gaps: DataFrame, gap: Column, width: float, kernel: Sequence[float] = (1.0, 0.2, 0.05), most: int = 8) -> DataFrame:
    """Weight of each bin as a common divisor of the gaps: every gap / k, k up to ``most``, spreads a kernel over its bins."""
    spread = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(kernel[abs(o)]).alias("w")) for o in range(1 - len(kernel), len(kernel))])).alias("x")
    parts = gaps.select(gap.alias("g")).where(F.col("g") > 0).select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "g")
    bins = parts.select(F.floor(F.col("g") / F.col("k") / F.lit(width)).cast("long").alias("b"), spread)
    return bins.select((F.col("b") + F.col("x.o")).alias("bin"), F.col("x.w").alias("w")).where(F.col("bin") >= 0).groupBy("bin").agg(F.sum("w").alias("weight"))


def smooth_histogram(bins: DataFrame, key: str, sigma: float, half: int) -> DataFrame:
    """Bins (key, bin, y) under a Gaussian of ``half`` bins to either side, over its largest value."""
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-half, half + 1)]
    spread = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in zip(range(-half, half + 1), weights, strict=True)])).alias("x")
    moved = bins.select(key, F.col("y"), F.col("bin"), spread).select(key, (F.col("bin") + F.col("x.o")).alias("bin"), (F.col("y") * F.col("x.w")).alias("y"))
    total = moved.groupBy(key, "bin").agg(F.sum("y").alias("y")).join(bins.select(key, "bin"), [key, "bin"], "left_semi")
    top = F.max("y").over(W.partitionBy(key))
    return total.select(key, "bin", F.when(top > 0, F.col("y") / top).otherwise(0.0).alias("y"))


def unwrap_histogram(bins: DataFrame, key: str, octave: int) -> DataFrame:
    """Folded bins (key, bin, y): what lies right of the last lowest bin is moved an octave down."""
    low = F.max_by("bin", F.struct(-F.col("y"), F.col("bin"))).over(W.partitionBy(key))
    return bins.withColumn("low", low).select(key, F.when(F.col("bin") > F.col("low"), F.col("bin") - octave).otherwise(F.col("bin")).alias("bin"), "y")


def extend_octaves(pitches: DataFrame, octave: float = 1200.0, octaves: Sequence[int] = (-1, 0, 1, 2)) -> DataFrame:
    return pitches.select("rec_id", F.explode(F.array(*[F.col("pitch") + F.lit(octave * o) for o in octaves])).alias("pitch"))


def tuned_tonic(tonics: DataFrame, peaks: DataFrame, most: float = 100.0) -> DataFrame:
    """Tonics (rec_id, tonic) moved to the peak (rec_id, cents) nearest to 0, if it is within ``most`` cents."""
    near = peaks.groupBy("rec_id").agg(F.min_by("cents", F.struct(F.abs("cents").alias("d"), "cents")).alias("offset"))
    moved = F.when(F.abs("offset") < most, F.col("tonic") * F.pow(F.lit(2.0), F.col("offset") / 1200.0)).otherwise(F.col("tonic"))
    return tonics.join(near, "rec_id", "left").select("rec_id", moved.alias("tonic"))


def valid_levels(pitches: DataFrame) -> DataFrame:
    """The semitones (0 to 11) near a stable pitch of each recording, and the others."""
    level = F.pmod(F.round(F.col("pitch") / 100.0).cast("int"), F.lit(12))
    per = pitches.groupBy("rec_id").agg(F.array_sort(F.collect_set(level)).alias("valid"))
    return per.select("rec_id", "valid", F.array_except(F.sequence(F.lit(0), F.lit(11)), "valid").alias("ignored"))


#: Cells of a surface that are multiplied at once, most copies of a surface that count as one.
_CELLS, _COPIES = 1024, 256


def _entries(surfaces: DataFrame) -> DataFrame:
    """Surfaces in the types of a block, written once."""
    cell = [F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c) for c in ("i", "j")]
    known = (F.col("i").isNotNull() & F.col("j").isNotNull()).alias("known")
    return stored(surfaces.where(F.col("rec_id").isNotNull()).select(F.col("rec_id").cast("long").alias("rec_id"), *cell, F.col("n").cast("double").alias("n"), known), "surfaces")


def _spooled(surfaces: DataFrame, most: int, least: int) -> tuple[str, list[str]]:
    """Folder and files of blocks of whole surfaces: up to ``most`` in a block on average, and ``least`` blocks of many."""
    folder = f"{shared_folder(surfaces.sparkSession)}/tessitura/surfaces-{uuid.uuid4().hex}"
    rows = _entries(surfaces)
    count = rows.agg(F.countDistinct("rec_id")).first()[0]
    number = F.pmod(F.xxhash64("rec_id"), F.lit(max(1, -(-count // min(most, blocks.block_size(count, least))))))

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"name": [blocks.put(folder, table.select(["rec_id", "i", "j", "n", "known"]).sort_by("rec_id"))]})

    return folder, sorted(r.name for r in rows.withColumn("_number", number).groupBy("_number").applyInArrow(run, "name string").collect())


def _copies(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The surfaces that differ, each under the first of its recordings, and those recordings (rec_id, copy), in order.

    A surface of over ``_COPIES`` recordings counts as several.
    """
    table = table.select(["rec_id", "i", "j", "n", "known"]).sort_by([(c, "ascending") for c in ("rec_id", "i", "j", "known", "n")])
    rec_id, i, j, n, known = (c.to_numpy() for c in table.columns)
    cells = np.column_stack([i, j, np.ascontiguousarray(n).view(np.int64), known.astype(np.int64)])
    recs, start = np.unique(rec_id, return_index=True)
    end = np.r_[start[1:], len(rec_id)]
    found: dict[bytes, list[int]] = {}
    first = []
    for rec, a, b in zip(recs.tolist(), start.tolist(), end.tolist(), strict=True):
        same = found.setdefault(cells[a:b].tobytes(), [])
        same.append(rec)
        first.append(same[(len(same) - 1) // _COPIES * _COPIES])
    order = np.argsort(first, kind="stable")
    return table.filter(pa.array(np.repeat(recs == first, end - start))), pa.table({"rec_id": np.array(first)[order], "copy": recs[order]})


def _spooled_copies(surfaces: DataFrame, most: int, least: int) -> tuple[str, list[tuple[str, str]]]:
    """Folder and files of blocks of whole surfaces, copies side by side: the surfaces that differ, and their recordings.

    Recordings are numbered in an order that has copies together and cut into blocks of one size, so that no block grows
    with a surface's copies.
    """
    folder = f"{shared_folder(surfaces.sparkSession)}/tessitura/surfaces-{uuid.uuid4().hex}"
    rows = _entries(surfaces)
    like = rows.groupBy("rec_id").agg(F.bit_xor(F.xxhash64("i", "j", "n", "known")).alias("_like"))
    place = stored(numbered(like, "_place", "_like", "rec_id").select("rec_id", "_place"), "places")
    size = min(most, blocks.block_size(place.count(), least))
    number = place.select("rec_id", F.floor(F.col("_place") / size).alias("_number"))

    def run(table: pa.Table) -> pa.Table:
        differ, copies = _copies(table)
        return pa.table({"name": [blocks.put(folder, differ)], "copies": [blocks.put(folder, copies)]})

    found = rows.join(number, "rec_id").groupBy("_number").applyInArrow(run, "name string, copies string").collect()
    return folder, sorted((r.name, r.copies) for r in found)


class _Surfaces:
    """A block of surfaces: their recordings, the row, cell and share of each entry, and their sums of squares.

    An entry of an unknown cell counts in sums over its surface but is shared with none.
    """

    def __init__(self, table: pa.Table, power: float) -> None:
        rec_id, i, j, n = (table.column(c).to_numpy() for c in ("rec_id", "i", "j", "n"))
        self.recs, row = np.unique(rec_id, return_inverse=True)
        v = n**power
        v = v / np.bincount(row, v)[row]
        self.squares = np.bincount(row, v * v)
        known = np.flatnonzero(table.column("known").to_numpy())
        self.row, self.v = row[known], v[known]
        self.cells, self.cell = np.unique(np.stack([i[known], j[known]], axis=1), axis=0, return_inverse=True)

    def products(self, right: _Surfaces, what: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums over the shared cells of what of the left times what of the right, for all pairs."""
        n = len(self.cells)
        cells, number, times = np.unique(np.concatenate([self.cells, right.cells]), axis=0, return_inverse=True, return_counts=True)
        both = np.flatnonzero(times == 2)
        place = np.full(len(cells), -1)
        place[both] = np.arange(len(both))
        mine, its = place[number[:n]][self.cell], place[number[n:]][right.cell]
        out = np.zeros((len(self.recs), len(right.recs)))
        for at in range(0, len(both), _CELLS):
            dense = []
            for side, cell in ((self, mine), (right, its)):
                here = np.flatnonzero((cell >= at) & (cell < at + _CELLS))
                matrix = np.zeros((len(side.recs), min(_CELLS, len(both) - at)))
                matrix[side.row[here], cell[here] - at] = what(side.v[here])
                dense.append(matrix)
            out += dense[0] @ dense[1].T
        return out


def surface_distances(surfaces: DataFrame, power: float = 1.0, digits: int | None = None) -> DataFrame:
    """Distances between sparse surfaces (rec_id, i, j, n), each scaled to sum 1 after ``n ** power``: Euclidean, Bhattacharyya.

    Each unordered pair that shares a cell once. Pairs that share none are left out: their Bhattacharyya distance is
    infinite, the Euclidean one follows from both sums of squares. Surfaces lie in blocks, and a pair of blocks is multiplied
    as matrices over the cells that both have; cells are never joined. Distances are rounded to ``digits``, if given.

    Equal surfaces are compared once. Their recordings leave Python as two lists and are paired behind it, so that pairs of
    copies follow each other and take next to no room where columns are encoded by runs.
    """
    folder, names = _spooled_copies(surfaces, 1024, 8)
    work = [(one, other) for at, one in enumerate(names) for other in names[at:]]
    of = pa.list_(pa.int64())
    schema = pa.schema([("a", of), ("b", of), ("euclidean", pa.float64()), ("bhattacharyya", pa.float64())])

    def read(block: tuple[str, str]) -> tuple[_Surfaces, pa.ListArray, np.ndarray, np.ndarray]:
        """Surfaces, their recordings, and the first and last of those."""
        surface, copies = _Surfaces(blocks.get(folder, block[0]), power), blocks.get(folder, block[1])
        start = np.r_[np.searchsorted(copies.column("rec_id").to_numpy(), surface.recs), len(copies)]
        recs = copies.column("copy").combine_chunks()
        return surface, pa.ListArray.from_arrays(pa.array(start, pa.int32()), recs), recs.to_numpy()[start[:-1]], recs.to_numpy()[start[1:] - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                (left, *its), (right, *others) = [read(block) for block in work[t]]
                dot, overlap = left.products(right, lambda v: v), left.products(right, np.sqrt)
                if work[t][0] == work[t][1]:
                    overlap[np.tri(*overlap.shape, k=-1, dtype=bool)] = 0.0
                for at in range(0, len(overlap), 128):
                    i, j = np.nonzero(overlap[at : at + 128] > 0)
                    i += at
                    far = np.sqrt(np.maximum(0.0, left.squares[i] + right.squares[j] - 2 * dot[i, j]))
                    far, near = (blocks.rounded(d, digits) for d in (far, -np.log(overlap[i, j])))
                    for (recs, first, _), a, (partners, _, last), b, both in ((its, i, others, j, True), (others, j, its, i, work[t][0] != work[t][1])):
                        # The smaller recording is on the left; a surface meets its own copies in one of the two turns.
                        some = np.flatnonzero((first[a] < last[b]) & (both | (i != j)))
                        columns = recs.take(pa.array(a[some])), partners.take(pa.array(b[some])), far[some], near[some]
                        yield pa.record_batch([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    met = tasks(surfaces.sparkSession, len(work)).mapInArrow(run, "a array<long>, b array<long>, euclidean double, bhattacharyya double")
    by_left = met.select(F.explode("a").alias("a"), "b", "euclidean", "bhattacharyya")
    return by_left.select("a", F.explode("b").alias("b"), "euclidean", "bhattacharyya").where("a < b")


def nearest_surfaces(surfaces: DataFrame, k: int, digits: int, power: float = 1.0) -> DataFrame:
    """a, b, d, rank: the ``k`` surfaces that share a cell with each and are nearest by Bhattacharyya distance, rounded to
    ``digits``, and then by key. No pair leaves the task of its left block."""
    folder, names = _spooled(surfaces, blocks.SIZE, 24)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()), ("rank", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("id").to_pylist():
                left = _Surfaces(blocks.get(folder, names[t]), power)
                best = blocks.Best(len(left.recs), k, digits)
                for name in names[t:] + names[:t]:
                    right = left if name == names[t] else _Surfaces(blocks.get(folder, name), power)
                    overlap = left.products(right, np.sqrt)
                    if right is left:
                        np.fill_diagonal(overlap, 0.0)
                        if len(right.recs) > k:
                            # The overlap of the k-th partner, a little less for rounding; without k partners any will do.
                            least = np.partition(overlap, -k, axis=1)[:, -k]
                            best.worst = np.where(least > 0, blocks.rounded(-np.log(np.maximum(least, 1e-300)), digits), np.inf)
                    least = np.exp(-best.limits()) * (1 - 1e-12)
                    i, j = np.nonzero((overlap >= least[:, None]) & (overlap > 0))
                    if len(i):
                        none = np.zeros(len(i))
                        best.put(i, {"rec_id": right.recs[j], "sub_id": none.astype(np.int64), "s_time": none, "e_time": none}, -np.log(overlap[i, j]))
                if len(best.owner):
                    columns = left.recs[best.owner], best.rows["rec_id"], best.rows["rank_by"] + 0.0, best.place + 1
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return tasks(surfaces.sparkSession, len(names)).mapInArrow(run, "a long, b long, d double, rank int")


def completeness(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows that have each column, and its distinct values."""
    parts = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]
    long = rows.select(F.explode(F.array(*parts)).alias("p")).select("p.field", "p.value")
    return long.groupBy("field").agg((F.count("value") / F.count(F.lit(1))).alias("share"), F.countDistinct("value").alias("different"))


def rank_recurring(members: DataFrame) -> DataFrame:
    """Communities (community, label, rec) by size times the centroids of their labels' and recordings' ranked counts."""

    def centroid(column: str, name: str) -> DataFrame:
        counts = members.groupBy("community", column).agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("community").orderBy(F.col("n").desc(), column)))
        return ranked.groupBy("community").agg((F.sum(F.col("rank") * F.col("n")) / F.sum("n")).alias(name), F.sum("n").alias(f"{name}_size"))

    joined = centroid("label", "by_label").join(centroid("rec", "by_rec"), "community")
    return joined.select("community", F.col("by_label_size").alias("size"), F.round(F.col("by_label_size") * F.col("by_label") * F.col("by_rec"), 2).alias("score"))
