"""Near-dedup of whole texts for the SimHash operator: links at a shingle similarity, complete at every size.

Texts are sets of hashed runs of WORDS words; two are linked if their sets' Jaccard similarity is at least LEAST, which is
verified on the texts. Sets are named by a signature of 64 bits, which equal sets share. Candidates come in two ways.

First by fingerprints: sets whose SimHashes the Golay keys link. At a similarity of 0.8 about ten of 64 bits differ, beyond
what any code of that length corrects, so keys alone can't give right results: they find copies with few edits only.
Therefore, second, by a prefix filter: a set of n shingles that is linked with another shares one of its first
n - ceil(LEAST n) + 1 shingles with it, in any order that all sets keep; no link is missed. The order puts rare shingles
first by a sketch of their counts, so common passages make few candidates. Sizes and places in the order rule further
candidates out. Sets that share a shingle are first compared along a chain. What
fingerprints and chains leave in different components is compared in pairs of blocks of bounded size; no list of pairs is
made. First by bitmaps of two to four bits a shingle, which bound the shingles two sets can have in common from above: sets
that no set of another component can be linked with need no more. The texts of the others are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SpanHasher, chosen, chunks, forest, identity, materialize, mix64, partitions, released, split_words, utf8
from .components import connected_components
from .simhash import fingerprint_links
from .spool import grouped

WORDS, LEAST = 5, "0.8"
#: Buckets of the sketch of shingle counts, and the pieces it is added up in: rows of 8 KB, dealt over all partitions.
BUCKETS, PIECES = 1 << 20, 1 << 10
#: Sets that are compared as one block, and shingles of such a block.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18
#: Text bytes that are turned into shingles at once, and shingles whose bits are added up at once.
SHINGLED, PRINTED = 1 << 18, 1 << 14
#: Columns of the matrix that counts common shingles.
COLUMNS = 1 << 14
_B = np.uint64(0x9FB21C651E98DF25)


def shingles(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct run of ``words`` words, lower-cased in A-Z, ascending; shorter texts are one run."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, rows = split_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = hasher(data, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    n = max(0, len(rows) - words + 1)
    whole = hashes[:n].copy()
    for k in range(1, words):
        whole *= _B
        whole += hashes[k : k + n]
    inside = np.flatnonzero(rows[:n] == rows[words - 1 :]) if n else np.zeros(0, np.int64)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < words))
    run = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        more = k < count[short]
        run[more] = run[more] * _B + hashes[first[short[more]] + k]
    run += count[short].astype(np.uint64)
    row, found = np.r_[rows[inside], short], mix64(np.r_[whole[inside], run])
    order = np.lexsort((found, row))
    row, found = row[order], found[order]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (found[1:] != found[:-1])]
    return row[fresh], found[fresh]


def _signatures(row: np.ndarray, found: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A signed 64-bit name of each row's set, 0 for the empty one, and its size."""
    size = np.bincount(row, minlength=rows)
    some = np.flatnonzero(size)
    names = np.zeros(rows, np.uint64)
    if len(some):
        names[some] = mix64(np.add.reduceat(mix64(found ^ _B), (np.cumsum(size) - size)[some]) + size[some].astype(np.uint64))
    return names.view(np.int64), size


def fingerprints(row: np.ndarray, found: np.ndarray, rows: int) -> np.ndarray:
    """The SimHash of each row's set: a bit is 1 if it is set in over half the hashes; 0 for the empty set."""
    out = np.zeros(rows, np.int64)
    size = np.bincount(row, minlength=rows)
    some = np.flatnonzero(size)
    ones = np.zeros((rows, 64), np.int64)
    for lo in range(0, len(found), PRINTED):
        part, mine = np.ascontiguousarray(found[lo : lo + PRINTED]), row[lo : lo + PRINTED]
        first = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * ones[some] > size[some, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def _bitmaps(row: np.ndarray, found: np.ndarray, size: np.ndarray) -> pa.Array:
    """A bitmap of each row's set, of the least power of two of bits that is 64 or more and twice the set's size or more."""
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(1, 2 * size))).astype(np.int64)))
    first = np.cumsum(bits) - bits
    flags = np.zeros(int(bits.sum()), np.uint8)
    flags[first[row] + (found & (bits[row] - 1).astype(np.uint64)).astype(np.int64)] = 1
    offsets = np.r_[0, np.cumsum(bits // 8)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(flags, bitorder="little"))]).cast(pa.binary())


def _signed(words: int):
    """key, doc_id, signature, fingerprint and bitmap of every text, and the task's part of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = SpanHasher(), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for lo, hi in chunks(offs, SHINGLED):
                row, found = shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], hasher, words)
                np.add.at(counts, (found >> np.uint64(44)).astype(np.int64), 1)
                names, size = _signatures(row, found, hi - lo)
                known = {c: batch.column(c).slice(lo, hi - lo) for c in ("key", "doc_id")}
                yield pa.record_batch(known | {"sig": pa.array(names), "fp": pa.array(fingerprints(row, found, hi - lo)), "bits": _bitmaps(row, found, size), "piece": pa.nulls(hi - lo, pa.int32()), "counts": pa.nulls(hi - lo, pa.binary())})
        if counts.any():
            blobs = [p.tobytes() for p in counts.reshape(PIECES, -1)]
            yield pa.record_batch({"key": pa.nulls(PIECES, pa.string()), "doc_id": pa.nulls(PIECES, pa.int64()), "sig": pa.nulls(PIECES, pa.int64()), "fp": pa.nulls(PIECES, pa.int64()), "bits": pa.nulls(PIECES, pa.binary()), "piece": pa.array(np.arange(PIECES, dtype=np.int32)), "counts": pa.array(blobs, pa.binary())})

    return run


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twice the binary logarithm of each bucket's count."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, blob in zip(batch.column("piece").to_pylist(), batch.column("counts"), strict=True):
            total[piece] = total.get(piece, 0) + np.frombuffer(blob.as_py(), np.int64)
    if total:
        blobs = [(2 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.record_batch({"piece": pa.array(list(total), pa.int32()), "levels": pa.array(blobs, pa.binary())})


def _prefixes(words: int, least: Fraction, sketch):
    """The shingles of each set that a linked set can't all lack, with the set's name and size and their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = SpanHasher(), np.frombuffer(sketch.value, np.uint8)
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for lo, hi in chunks(offs, SHINGLED):
                row, found = shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], hasher, words)
                names, size = _signatures(row, found, hi - lo)
                order = np.lexsort((found, levels[(found >> np.uint64(44)).astype(np.int64)], row))
                place = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                enough = size + 1 + (-size * least.numerator // least.denominator)  # n - ceil(least n) + 1
                keep = place < enough[row]
                row, found, place = row[keep], found[order][keep], place[keep]
                yield pa.record_batch({"key": pa.array(found.view(np.int64)), "sig": pa.array(names[row]), "n": pa.array(size[row].astype(np.int32)), "place": pa.array(place.astype(np.int32))})

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key others have too, with the row before of the same key; rows come sorted by key, size and name."""
    names = ("key", "sig", "n", "place")
    kept, before = None, None

    def put(rows: list, keep: np.ndarray, prev: list, has: np.ndarray) -> pa.RecordBatch:
        columns = {c: pa.array(x[keep]) for c, x in zip(names, rows, strict=True)}
        for c, x in zip(("sig", "n", "place"), prev, strict=True):
            columns[f"last_{c}"] = pa.array(x[keep], mask=~has[keep])
        return pa.record_batch(columns)

    for batch in batches:
        if not len(batch):
            continue
        rows = [batch.column(c).to_numpy() for c in names]
        if kept is not None:
            rows = [np.r_[k, x] for k, x in zip(kept, rows, strict=True)]
        fresh = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]  # a set's copies count once
        rows = [x[fresh] for x in rows]
        prev = [np.r_[x[:1], x[:-1]] for x in rows[1:]]
        has = np.r_[False, rows[0][1:] == rows[0][:-1]]
        if before is not None:
            has[0] = True
            for p, b in zip(prev, before, strict=True):
                p[0] = b
        shared = has | np.r_[has[1:], False]
        shared[-1] = False
        if shared.any():
            yield put(rows, np.flatnonzero(shared), prev, has)
        kept = [x[-1:] for x in rows]
        before = [p[-1] for p in prev] if has[-1] else None
    if before is not None:
        yield put(kept, np.array([0]), [np.array([b], x.dtype) for b, x in zip(before, kept[1:], strict=True)], np.array([True]))


def _named(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            for lo, hi in chunks(offs, SHINGLED):
                names, _ = _signatures(*shingles(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], hasher, words), hi - lo)
                yield pa.record_batch({"sig": pa.array(names), "text": batch.column("text").slice(lo, hi - lo)})

    return run


def _verified(words: int, least: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for batch in batches:
            (raw_a, at_a), (raw_b, at_b) = utf8(batch.column("text_a")), utf8(batch.column("text_b"))
            for lo, hi in chunks(at_a + at_b, SHINGLED):
                sides = [shingles(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], hasher, words) for raw, at in ((raw_a, at_a), (raw_b, at_b))]
                row, found = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                both = np.bincount(row[1:][(row[1:] == row[:-1]) & (found[1:] == found[:-1])], minlength=hi - lo)
                union = np.bincount(row, minlength=hi - lo) - both
                near = pa.array(both * least.denominator >= union * least.numerator)
                yield pa.record_batch({c: batch.column(c).slice(lo, hi - lo).filter(near) for c in ("a", "b")})

    return run


def _links(pairs: DataFrame, rows: DataFrame, words: int, least: Fraction) -> DataFrame:
    """The pairs a, b of set names whose texts are similar enough."""
    needed = materialize(pairs.select(F.col("a").alias("need")).union(pairs.select("b")).distinct(), "needed")
    named = rows.select("text").mapInArrow(released(_named(words)), "sig long, text string").join(needed, F.col("sig") == F.col("need"), "left_semi")
    texts = materialize(named.groupBy("sig").agg(F.min("text").alias("text")), "texts")
    one, other = (texts.select(F.col("sig").alias(f"sig_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    full = pairs.join(one, F.col("a") == F.col("sig_a")).join(other, F.col("b") == F.col("sig_b"))
    return materialize(full.select("a", "b", "text_a", "text_b").mapInArrow(released(_verified(words, least)), "a long, b long"), "near")


def _print_pairs(names: DataFrame) -> DataFrame:
    """Pairs a, b of set names that Golay keys join: the least set of each fingerprint with its others and along the links."""
    sets = names.select("fp", "sig").distinct()
    least = materialize(sets.groupBy("fp").agg(F.min("sig").alias("low")), "prints")
    one, other = (least.select(F.col("fp").alias(f"fp_{s}"), F.col("low").alias(s)) for s in "ab")
    links = fingerprint_links(least.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    linked = links.join(one, F.col("x") == F.col("fp_a")).join(other, F.col("y") == F.col("fp_b")).select("a", "b")
    same = sets.join(least.select(F.col("fp").alias("fp_s"), F.col("low").alias("a")), F.col("fp") == F.col("fp_s")).where(F.col("sig") != F.col("a")).select("a", F.col("sig").alias("b"))
    both = linked.unionByName(same)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Sets whose shingles also sets of other components have: low, sig, root and n. low is the least root of a shingle's sets, so that the shingles of one group of near copies make one group here."""
    rest = groups.select("key", "sig", "n").join(roots, F.col("sig") == F.col("node"), "left").select("key", "sig", "n", F.coalesce("root", "sig").alias("root"))
    spans = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    mixed = spans.where(F.col("low") != F.col("high")).select(F.col("key").alias("k"), "low")
    return rest.join(mixed, F.col("key") == F.col("k")).select("low", "sig", "root", "n").distinct()


def _compared(words: int, least: Fraction):
    """Links between sets of different components within each pair of blocks, no more than there are sets."""

    def links(sig: np.ndarray, root: np.ndarray, side: np.ndarray, same: bool, row: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(row, minlength=len(sig))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        _, column, times = np.unique(found, return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + COLUMNS))
            has = np.zeros((len(sig), COLUMNS), np.float32)
            has[row[a:b], column[a:b] - lo] = 1
            common += has[left] @ has[right].T
        common = common.astype(np.int64)
        union = size[left][:, None] + size[right][None] - common
        near = (common * least.denominator >= union * least.numerator) & (root[left][:, None] != root[right][None])
        a, b = np.nonzero(near)
        return forest(left[a], right[b], len(sig))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHasher()
        for _, rows in grouped(batches, "task"):
            raw, offs = utf8(rows.column("text"))
            row, found = shingles(raw[offs[0] : offs[-1]], offs - offs[0], hasher, words)
            sig, root, side = (rows.column(c).to_numpy() for c in ("sig", "root", "side"))
            a, b = links(sig, root, side, bool(rows.column("same")[0].as_py()), row, found)
            if len(a):
                yield pa.record_batch({"a": pa.array(sig[a]), "b": pa.array(sig[b])})

    return run


def _possible(least: Fraction):
    """low and sig of the sets that a set of another component can be linked with, as far as bitmaps tell."""

    def folded(raw: np.ndarray, starts: np.ndarray, size: int, to: int) -> np.ndarray:
        return np.bitwise_or.reduce(raw[starts[:, None] + np.arange(size)].reshape(len(starts), -1, to), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in grouped(batches, "task"):
            raw, offs = utf8(rows.column("bits"))
            n, root, side = (rows.column(c).to_numpy() for c in ("n", "root", "side"))
            same, lens, hit = bool(rows.column("same")[0].as_py()), np.diff(offs), np.zeros(len(n), bool)
            sizes = np.unique(lens).tolist()
            for size in sizes:
                others = [x for x in sizes if x >= size and x * least.numerator < 2 * size * least.denominator]
                at = [np.flatnonzero(lens == x) for x in others]
                table = np.concatenate([folded(raw, offs[:-1][i], x, size) for x, i in zip(others, at, strict=True)])
                one, all_ = at[0], np.concatenate(at)
                common = np.zeros((len(one), len(all_)), np.float32)
                for lo in range(0, size, COLUMNS // 32):
                    bits = np.unpackbits(table[:, lo : lo + COLUMNS // 32], axis=1).astype(np.float32)
                    common += bits[: len(one)] @ bits.T
                spare = n[all_] - np.bitwise_count(table).sum(axis=1, dtype=np.int64)  # shingles that share a bit
                most = common.astype(np.int64) + np.minimum(spare[: len(one), None], spare[None])
                most = np.minimum(most, np.minimum(n[one][:, None], n[all_][None]))
                near = most * (least.numerator + least.denominator) >= (n[one].astype(np.int64)[:, None] + n[all_][None]) * least.numerator
                near &= root[one][:, None] != root[all_][None]
                if not same:
                    near &= side[one][:, None] != side[all_][None]
                hit[one[near.any(axis=1)]] = True
                hit[all_[near.any(axis=0)]] = True
            yield pa.record_batch({c: rows.column(c).combine_chunks().filter(pa.array(hit)) for c in ("low", "sig", "root", "n")})

    return run


def _in_blocks(members: DataFrame, block: int, kept: DataFrame, column: str) -> DataFrame:
    """Members with what ``kept`` (sig and ``column``) has of them, once for each pair of blocks of their group that they are in."""
    wanted = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    sizes = members.groupBy(F.col("low").alias("l")).agg(wanted.alias("blocks"))
    placed = members.join(sizes, F.col("low") == F.col("l")).withColumn("mine", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    first, last = F.least("mine", "other"), F.greatest("mine", "other")
    known = ["low", "sig", "root", "n", F.xxhash64("low", first, last).alias("task"), (F.col("mine") == F.col("other")).alias("same"), F.when(F.col("mine") == first, 0).otherwise(1).alias("side")]
    full = placed.select(*known).join(kept.select(F.col("sig").alias("of"), column), F.col("sig") == F.col("of")).drop("of")
    return full.repartition(partitions(members.sparkSession), "task").sortWithinPartitions("task", "side", "sig")


def _compared_blocks(members: DataFrame, bitmaps: DataFrame, rows: DataFrame, words: int, least: Fraction, block: int) -> DataFrame:
    """Links a, b between sets of one group (low) and different components; groups are cut into blocks of bounded size."""
    known = bitmaps.groupBy("sig").agg(F.min("bits").alias("bits"))
    asked = _in_blocks(members, 4 * block, known, "bits").mapInArrow(released(_possible(least)), "low long, sig long, root long, n int")
    left = materialize(asked.distinct(), "possible")
    needed = left.select(F.col("sig").alias("need")).distinct()
    named = rows.select("text").mapInArrow(released(_named(words)), "sig long, text string").join(needed, F.col("sig") == F.col("need"), "left_semi")
    texts = materialize(named.groupBy("sig").agg(F.min("text").alias("text")), "texts")
    dealt = _in_blocks(left, block, texts, "text")
    return materialize(dealt.mapInArrow(released(_compared(words, least)), "a long, b long"), "near")


def _components(docs: DataFrame, words: int, least: str, block: int) -> tuple[DataFrame, DataFrame]:
    """key, doc_id and sig of every row, and roots (node, root) of the sets that aren't their component's least."""
    share = Fraction(least)
    if not 0 < share <= 1:
        raise ValueError("least is above 0 and at most 1")
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), identity(docs["doc_id"], docs["text"]).alias("key"))
    signed = materialize(rows.mapInArrow(released(_signed(words)), "key string, doc_id long, sig long, fp long, bits binary, piece int, counts binary"), "signatures")
    names = signed.where(F.col("sig").isNotNull()).select("key", "doc_id", "sig", "fp")
    added = signed.where(F.col("piece").isNotNull()).select("piece", "counts").repartition(n, "piece").mapInArrow(released(_levels), "piece int, levels binary")
    found = {r.piece: bytes(r.levels) for r in added.collect()}
    sketch = spark.sparkContext.broadcast(b"".join(found.get(k, bytes(BUCKETS // PIECES)) for k in range(PIECES)))

    keyed = rows.select("text").mapInArrow(released(_prefixes(words, share, sketch)), "key long, sig long, n int, place int")
    dealt = keyed.repartition(n, "key").sortWithinPartitions("key", "n", "sig")
    groups = materialize(dealt.mapInArrow(released(_chained), "key long, sig long, n int, place int, last_sig long, last_n int, last_place int"), "shingles")

    def possible(n_a: Column, n_b: Column, place_a: Column, place_b: Column) -> Column:
        """Sizes and places that leave room for enough common shingles, if the key is the first one in common."""
        room = F.least(n_a - place_a, n_b - place_b)
        return (F.least(n_a, n_b) * share.denominator >= F.greatest(n_a, n_b) * share.numerator) & (room * (share.numerator + share.denominator) >= (n_a + n_b) * share.numerator)

    near = possible(F.col("n"), F.col("last_n"), F.col("place"), F.col("last_place"))
    pairs = groups.where(F.col("last_sig").isNotNull() & near).select(F.least("sig", "last_sig").alias("a"), F.greatest("sig", "last_sig").alias("b"))
    tried = materialize(pairs.unionByName(_print_pairs(names)).distinct(), "pairs")
    links = _links(tried, rows, words, share)
    roots = connected_components(links)
    members = materialize(_apart(groups, roots), "apart")
    if not members.isEmpty():
        bitmaps = signed.where(F.col("sig").isNotNull()).select("sig", "bits")
        more = _compared_blocks(members, bitmaps, rows, words, share, block)
        roots = connected_components(links.unionByName(more))
    return names.drop("fp"), roots


def similar_documents(docs: DataFrame, words: int = WORDS, least: str = LEAST, block: int = BLOCK) -> DataFrame:
    """Every document's doc_id, sig and component_id: the smallest doc_id reachable over links of similarity ``least`` or more.

    Cases: null, empty and wordless texts are one set and linked with each other alone; texts of fewer words than a shingle
    are one shingle; repeated rows are linked like other equal texts; a null doc_id is never the smallest unless its
    component has no other; an empty table gives no rows; other columns are left out.
    """
    names, roots = _components(docs, words, least, block)
    distinct = names.groupBy("sig").agg(F.min("doc_id").alias("smallest"))
    rooted = distinct.join(roots, distinct["sig"] == roots["node"], "left").select("sig", "smallest", F.coalesce("root", "sig").alias("top"))
    component = rooted.groupBy("top").agg(F.min("smallest").alias("component_id"))
    known = rooted.select("sig", "top").join(component, "top").select("sig", "component_id")
    return names.join(known, "sig").select("doc_id", "sig", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, least: str = LEAST) -> DataFrame:
    """One document of each component with all its columns: the one with the smallest doc_id.

    Cases as in ``similar_documents``. Where several rows have that doc_id (or all of a component have none), the one whose
    hash of doc_id and text is the smallest stays, and of rows that share both a single one.
    """
    names, roots = _components(docs, words, least, BLOCK)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = names.groupBy("sig").agg(F.min(rank).alias("first"))
    rooted = distinct.join(roots, distinct["sig"] == roots["node"], "left").select("first", F.coalesce("root", "sig").alias("top"))
    stays = rooted.groupBy("top").agg(F.min("first").alias("first")).select(F.col("first.key").alias("stay"))
    counts = names.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    plan = counts.join(stays, F.col("key") == F.col("stay"), "left_semi").select("key", "rows", F.lit(1).alias("copies"))
    return chosen(docs, [identity(docs["doc_id"], docs["text"])], materialize(plan, "stays"))
