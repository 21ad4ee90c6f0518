"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against the collection itself, whose index is dealt out in reference blocks. The unit of the
index is the window of WINDOW words. A window's anchor is the leftmost least hash among its runs of five words, so equal
windows have equal anchors at equal places. Consecutive windows of one anchor make a phrase; a block holds all phrases of
its anchors, with their words, and parses each against those of smaller documents: a factor runs on as long as the next
window is found, word by word, in a smaller document. Windows across a factor's boundary have anchors of their own and are
looked up like all others, and factors that overlap are joined. All words under a factor are duplicates.

Texts are read once and kept in spool files. First only anchors travel (8 bytes for each phrase), and come back if more
than one document has them; then the phrases of these travel with their words. A chunk settles its own repeats and sends a
phrase that many of its documents share once. A phrase's anchor that very many phrases have (more than HOT in a block) is
left to joins on whole windows, which spread over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import SpanHasher, fresh_path, materialize, mix64, partitions, released, split_words, utf8
from .spool import Spool, Writer, grouped, read, written

WINDOW, GRAM = 13, 5
#: Phrases of one anchor that one task holds; the windows of more are dealt out by themselves.
HOT = 200_000
#: Phrases of one spool file; bytes of text that are hashed at once.
FILE_PHRASES, CHUNK = 2_000_000, 4 << 20
_C = np.uint64(0xA0761D6478BD642F)
_SPOOL = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_PHRASE = "anchor long, part long, row long, start int, place int, n int, doc_id long, words binary"


def phrases(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, size: int = WINDOW) -> dict[str, np.ndarray]:
    """Phrases of every text: row, start (first window, in words), n (windows), place (of the anchor, after start), anchor, and the bytes lo to hi that they span."""
    starts, ends, rows = split_words(data, offsets)
    n = len(starts) - size + 1
    if n <= 0:
        return {c: np.zeros(0, np.uint64 if c == "anchor" else np.int64) for c in ("row", "start", "n", "place", "anchor", "lo", "hi")}
    words = hasher(data, starts, ends)
    gram = min(GRAM, size)
    m = len(words) - gram + 1
    hashes = words[:m].copy()
    for k in range(1, gram):
        hashes *= _C
        hashes += words[k : k + m]
    hashes = mix64(hashes)
    least, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, size - gram + 1):
        lower = hashes[k : k + n] < least
        least[lower] = hashes[k : k + n][lower]
        at[lower] = np.flatnonzero(lower) + k
    inside = np.flatnonzero(rows[:n] == rows[size - 1 :])
    if not len(inside):
        return phrases(data[:0], np.zeros(1, np.int64), hasher, size)
    fresh = np.flatnonzero(np.r_[True, (at[inside][1:] != at[inside][:-1]) | (inside[1:] != inside[:-1] + 1)])
    first = inside[fresh]
    count = np.diff(np.r_[fresh, len(inside)])
    row = rows[first]
    head = np.searchsorted(rows, np.arange(len(offsets) - 1))[row]
    return {"row": row, "start": first - head, "n": count, "place": at[first] - first, "anchor": mix64(least[first]), "lo": starts[first], "hi": ends[first + count + size - 2]}


def _chunk_phrases(chunk: pa.RecordBatch, hasher: SpanHasher, size: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A chunk's bytes and the phrases of its documents that have an identifier."""
    raw, offs = utf8(chunk.column("text"))
    data, own = raw[offs[0] : offs[-1]], offs - offs[0]
    found = phrases(data, own, hasher, size)
    known = chunk.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[found["row"]]
    return data, found if known.all() else {c: x[known] for c, x in found.items()}


def _spooled(folder: str, blocks: int, size: int, limit: int, chunk_bytes: int):
    """Writes the documents; hands on each file's anchors by block, those that several of its documents have twice."""

    class File(Writer):
        def __init__(self, folder: str, part: int, schema: pa.Schema) -> None:
            super().__init__(folder, part, schema)
            self.anchors, self.count = [], 0

        def add(self, chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            _, found = _chunk_phrases(chunk, hasher, size)
            order = np.lexsort((found["row"], found["anchor"]))
            anchor, row = found["anchor"][order], found["row"][order]
            once = anchor[np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])][: len(anchor)]]
            self.anchors.append(once)
            self.count += len(once)
            self.put(chunk)
            return iter(())

        def full(self) -> bool:
            return self.count > limit

        def finish(self) -> Iterator[pa.RecordBatch]:
            self.close()
            anchors, times = np.unique(np.concatenate(self.anchors), return_counts=True)
            anchors = np.repeat(anchors, np.minimum(times, 2))
            block = (anchors % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            anchors, block = anchors[order], block[order]
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else [0]
            blobs = [anchors[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            n = len(blobs) + 1
            to = pa.array([None, *block[edge[:-1]].tolist()], pa.int32())
            yield pa.record_batch({"part": pa.array([self.part] * n, pa.int64()), "file": pa.array([self.name] * n), "block": to, "anchors": pa.array([None, *blobs], pa.binary())})

    hasher = SpanHasher()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return written(batches, folder, _SPOOL, chunk_bytes, File)

    return run


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which anchors of each file more than one document has, for all files that ask one block."""
    for _, rows in grouped(batches, "block"):
        asked = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("anchors")]
        values, times = np.unique(np.concatenate(asked), return_counts=True)
        many = values[times > 1]
        parts, files = rows.column("part").to_pylist(), rows.column("file").to_pylist()
        for part, file, own in zip(parts, files, asked, strict=True):
            common = np.intersect1d(own, many, assume_unique=False)
            if len(common):
                yield pa.record_batch({"part": pa.array([part], pa.int64()), "file": pa.array([file]), "anchors": pa.array([common.tobytes()], pa.binary())})


def _asked(folder: str, size: int):
    """Phrases that the blocks shall parse, with their words, and the factors that a chunk finds itself (without words)."""

    def settled(chunk: pa.RecordBatch, base: int, many: np.ndarray, part: int, hasher: SpanHasher) -> Iterator[pa.RecordBatch]:
        data, found = _chunk_phrases(chunk, hasher, size)
        place = np.minimum(np.searchsorted(many, found["anchor"]), len(many) - 1)
        keep = np.flatnonzero(many[place] == found["anchor"])
        found = {c: x[keep] for c, x in found.items()}
        view = memoryview(data)
        words = [b" ".join(bytes(view[a:b]).split()) for a, b in zip(found["lo"].tolist(), found["hi"].tolist(), strict=True)]
        doc = chunk.column("doc_id").fill_null(0).to_numpy()[found["row"]]
        least: dict[tuple[int, bytes], int] = {}
        for p, w, d in zip(found["place"].tolist(), words, doc.tolist(), strict=True):
            known = least.get((p, w))
            if known is None or d < known:
                least[p, w] = d
        own = np.array([least[p, w] for p, w in zip(found["place"].tolist(), words, strict=True)], np.int64) < doc
        # What is settled needs no block; a hash of its place spreads it.
        key = np.where(own, mix64((base + found["row"]).astype(np.uint64) << np.uint64(32) ^ found["start"].astype(np.uint64)), found["anchor"])
        yield pa.record_batch({
            "anchor": pa.array(key.view(np.int64)), "part": pa.array(np.full(len(keep), part)), "row": pa.array(base + found["row"]),
            "start": pa.array(found["start"].astype(np.int32)), "place": pa.array(found["place"].astype(np.int32)), "n": pa.array(found["n"].astype(np.int32)),
            "doc_id": pa.array(doc), "words": pa.array([None if x else w for x, w in zip(own.tolist(), words, strict=True)], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for part, rows in grouped(batches):
            many = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("anchors")]))
            base = 0
            for chunk in read(folder, rows.column("file")[0].as_py()):
                yield from settled(chunk, base, many, part, hasher)
                base += len(chunk)

    return run


def parsed(group: list[tuple[int, bytes, int, int]], size: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Factors of every phrase of one anchor against the phrases of smaller documents: (first window, windows) each.

    A phrase is its place, words, windows and document. Windows are compared as text.
    """
    alike: dict[tuple[int, bytes], int] = {}
    for place, words, _, doc in group:
        known = alike.get((place, words))
        alike[place, words] = doc if known is None else min(known, doc)
    texts: dict[tuple[int, bytes], list[int]] = {}
    if len(alike) > 1:
        index: dict[tuple[int, bytes], int] = {}
        cut: dict[tuple[int, bytes], list[tuple[int, bytes]]] = {}
        for (place, words), doc in alike.items():
            ends = [i for i, c in enumerate(words) if c == 32]
            edges = [-1, *ends, len(words)]
            mine = [(place - k, words[edges[k] + 1 : edges[k + size]]) for k in range(len(edges) - size)]
            cut[place, words] = mine
            for key in mine:
                known = index.get(key)
                if known is None or doc < known:
                    index[key] = doc
        texts = {name: [index[key] for key in mine] for name, mine in cut.items()}
    out = []
    for place, words, n, doc in group:
        first = texts.get((place, words)) or [alike[place, words]] * n
        factors, k = [], 0
        while k < n:
            at = k
            while k < n and first[k] < doc:  # the longest match: on as long as the next window is found
                k += 1
            if k > at:
                factors.append((at, k - at))
            k += 1
        out.append(factors)
    return out


def _parsed(hot: int, size: int):
    """Factors (part, row, start, n); phrases of hot anchors pass through with their words. Rows come sorted by anchor."""
    names = ("part", "row", "start", "place", "n", "doc_id", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=list(names))

        def done(rows: list[tuple]) -> None:
            if len(rows) > 1 and any(r[5] != rows[0][5] for r in rows):
                for r, factors in zip(rows, parsed([(r[3], r[6], r[4], r[5]) for r in rows], size), strict=True):
                    found.extend((r[0], r[1], r[2] + at, 0, n, r[5], None) for at, n in factors)

        anchor, group, passing = None, [], False
        for rows in batches:
            columns = [rows.column(c).to_pylist() for c in names]
            for a, *r in zip(rows.column("anchor").to_pylist(), *columns, strict=True):
                if a != anchor:
                    if not passing:
                        done(group)
                    anchor, group, passing = a, [], False
                if passing:
                    found.append(tuple(r))
                else:
                    group.append(r)
                    if len(group) > hot:
                        found.extend(map(tuple, group))
                        group, passing = [], True
                if len(found) >= 50_000:
                    yield batch()
                    found.clear()
        if not passing:
            done(group)
        if found:
            yield batch()

    return run


def _blocks(hot: int, size: int):
    """What a task of blocks hands on: factors that chunks have settled, then those of the phrases it parses."""
    names = ["part", "row", "start", "place", "n", "doc_id", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[pa.RecordBatch] = []

        def phrases_only() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column("words").is_null()
                if own.true_count:
                    settled.append(batch.filter(own).select(names))
                yield batch.filter(batch.column("words").is_valid())

        for batch in _parsed(hot, size)(phrases_only()):
            yield from settled
            settled.clear()
            yield batch
        yield from settled

    return run


def _hot_factors(rows: DataFrame, size: int) -> DataFrame:
    """Factors of the phrases of hot anchors, a window at a time, by a join on the windows' words."""
    split = rows.withColumn("word", F.split(F.col("words").cast("string"), " ")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    windows = split.select("part", "row", (F.col("start") + F.col("k")).alias("start"), "doc_id", F.array_join(F.slice("word", F.col("k") + 1, size), " ").alias("window"))
    least = windows.groupBy("window").agg(F.min("doc_id").alias("least")).withColumnRenamed("window", "known")
    return windows.join(least, (F.col("window") == F.col("known")) & (F.col("doc_id") > F.col("least"))).select("part", "row", "start", F.lit(1).alias("n"))


def factors(pairs: np.ndarray, size: int = WINDOW) -> list[tuple[int, int]]:
    """Spans [start, end) in words of factors (first window, windows), joined where they overlap or touch."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    lo, hi = pairs[:, 0], np.maximum.accumulate(pairs[:, 0] + pairs[:, 1] - 1 + size)
    first = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[first].tolist(), hi[np.r_[first[1:] - 1, len(hi) - 1]].tolist(), strict=True))


def _cut(folder: str, size: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches):
            name = next(x for x in rows.column("file").unique().to_pylist() if x is not None)
            rows = rows.filter(rows.column("row").is_valid())
            row = rows.column("row").to_numpy()
            order = np.argsort(row, kind="stable")
            row, pairs = row[order], np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("start", "n")], axis=1)[order]
            del rows
            base = 0
            for chunk in read(folder, name):
                edges = np.searchsorted(row, np.arange(base, base + len(chunk) + 1))
                base += len(chunk)
                yield _without(chunk, [pairs[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], size, with_text)

    return run


def _without(chunk: pa.RecordBatch, answers: list[np.ndarray], size: int, with_text: bool) -> pa.RecordBatch:
    raw, offs = utf8(chunk.column("text"))
    view = memoryview(raw)
    rows = []
    for i, pairs in enumerate(answers):
        words = bytes(view[offs[i] : offs[i + 1]]).split()
        spans = factors(pairs, size) if len(pairs) else []
        gone = sum(b - a for a, b in spans)
        kept = words
        if spans:
            stay = bytearray(b"\1" * len(words))
            for a, b in spans:
                stay[a:b] = bytes(b - a)
            kept = compress(words, stay)
        text = b" ".join(kept)
        rows.append((len(words), gone, hashlib.sha256(text).hexdigest(), text if with_text else None, spans))
    n, gone, sha, text, spans = zip(*rows, strict=True) if rows else ((),) * 5
    columns = {"doc_id": chunk.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
    if with_text:
        columns["kept_text"] = pa.array(text, pa.binary()).cast(pa.string())
        columns["spans"] = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.record_batch(columns)


def remove_repeats(docs: DataFrame, size: int = WINDOW, *, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """Each document without the words under windows of ``size`` words that also start in a smaller document.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept_text (kept words joined by one space) and
    spans (removed words, [start, end)). Cases: null text has no words; texts of fewer than ``size`` words lose nothing; a
    null doc_id neither takes nor gives; rows with one doc_id don't count as smaller than each other and are each judged by
    their own text; windows repeated only within a document stay; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    n, folder = partitions(spark), fresh_path(spark, "spool")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    table = materialize(rows.mapInArrow(released(_spooled(folder, n, size, FILE_PHRASES, CHUNK)), "part long, file string, block int, anchors binary"), "anchors")
    texts = Spool(folder, table, n)
    blocks = table.where(F.col("block").isNotNull()).repartitionById(n, F.col("block")).sortWithinPartitions("block")
    shared = blocks.mapInArrow(released(_shared_anchors), "part long, file string, anchors binary")
    asked = texts.dealt(shared).mapInArrow(released(_asked(folder, size)), _PHRASE)
    # Factors that a chunk has found itself have no words and pass through.
    dealt = asked.repartition(n, "anchor").sortWithinPartitions("anchor")
    found = materialize(dealt.mapInArrow(released(_blocks(hot, size)), "part long, row long, start int, place int, n int, doc_id long, words binary"), "factors", compression="zstd")
    short = found.where(F.col("words").isNull()).select("part", "row", "start", "n")
    every = short.unionByName(_hot_factors(found.where(F.col("words").isNotNull()), size))
    files = table.where(F.col("block").isNull()).select("part", "file")
    answers = files.unionByName(every, allowMissingColumns=True)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<start: long, end: long>>" * with_text
    return texts.dealt(answers.select("part", "file", "row", "start", "n")).mapInArrow(released(_cut(folder, size, with_text)), schema)
