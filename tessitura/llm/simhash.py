"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into two Golay words of 23 bits (A, B) and a rest of 18 bits (R) with halves of 9. The
binary Golay code is perfect: every 23-bit word decodes to one codeword, named by a 12-bit index. The indices decoded from
a word and from its 23 one-bit neighbours are its fuzzy keys (one to six different ones). Words within two bits share a
fuzzy key, and if they are within one bit, each one's own index is among the other's fuzzy keys.

At most three bits differ in all, so one of these holds, and each gives a key that both fingerprints have:
R equal, A within 1; R equal, B within 1; A equal, B within 2; B equal, A within 2; A and B within 1 each and a half of R
equal (keys pair one side's fuzzy keys with the other side's own index, and the reverse). Fingerprints that share a key
are compared bit by bit. Keys are 30 to 35 bits long, about 40 a fingerprint, and only distinct fingerprints have any.

Within a key only the links of a spanning forest are put out, never all pairs. A key with more than BUCKET fingerprints
is compared in pairs of blocks that are dealt out over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._shared import materialize, partitions, utf8
from .components import connected_components

#: Fingerprints of one key that one task compares; more are compared in blocks of this many.
BUCKET = 4096
#: Fixed value: the generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the binary Golay code.
GOLAY = 0b110001110101


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 (seed 42) of every run of ``words`` words, lower-cased in A-Z; of the whole sequence if there are fewer."""
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return [xxh64_intdigest(joined, 42)]
    ends = list(accumulate(map(len, parts), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return [xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(text: bytes, words: int = 3) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[lo : lo + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(batch.column("text"))
            view = memoryview(raw)
            prints = [fingerprint(bytes(view[offs[i] : offs[i + 1]]), words) for i in range(len(offs) - 1)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64())})

    return run


@lru_cache(maxsize=1)
def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every upper half (12 bits) of a word, and error pattern of every syndrome."""

    def remainder(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    upper = np.array([remainder(x << 11) for x in range(1 << 12)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones if a < b for c in ones if b < c)]
    for e in patterns:
        errors[upper[e >> 11] ^ e & 0x7FF] = e
    return upper, errors


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    upper, errors = _golay_tables()
    return (words ^ errors[upper[words >> 11] ^ words & 0x7FF]) >> 11


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and index of every distinct fuzzy key of each 23-bit word."""
    keys = np.stack([golay_index(words), *(golay_index(words ^ (1 << i)) for i in range(23))], axis=1)
    keys.sort(axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, col = np.nonzero(fresh)
    return row, keys[row, col]


def link_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit key of all keys of each fingerprint. The key's top bits name the case."""
    x = prints.view(np.uint64)
    a, b, r = ((x >> np.uint64(s)) & np.uint64(m) for s, m in ((0, 0x7FFFFF), (23, 0x7FFFFF), (46, 0x3FFFF)))
    a, b, r = a.astype(np.int64), b.astype(np.int64), r.astype(np.int64)
    row_a, key_a = fuzzy_keys(a)
    row_b, key_b = fuzzy_keys(b)
    own_a, own_b = golay_index(a), golay_index(b)
    parts = [
        (row_a, 1 << 40 | r[row_a] << 12 | key_a),
        (row_b, 2 << 40 | r[row_b] << 12 | key_b),
        (row_b, 3 << 40 | a[row_b] << 12 | key_b),
        (row_a, 4 << 40 | b[row_a] << 12 | key_a),
    ]
    for case, half in ((5, r >> 9), (6, r & 0x1FF)):
        left = case << 40 | half[row_a] << 24 | key_a << 12 | own_b[row_a]
        right = case << 40 | half[row_b] << 24 | own_a[row_b] << 12 | key_b
        other = key_b != own_b[row_b]  # the pair of both own indices is among the left ones
        parts += [(row_a, left), (row_b[other], right[other])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        for lo in range(0, len(prints), 4096):
            part = np.ascontiguousarray(prints[lo : lo + 4096])
            row, key = link_keys(part)
            yield pa.record_batch({"key": pa.array(key), "fp": pa.array(part[row])})


def forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that join what is joined by differences of at most ``bits`` bits; fewer than there are fingerprints."""
    rest, out = prints.view(np.uint64), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            u = front.pop()
            near = np.bitwise_count(rest ^ u) <= bits
            if near.any():
                found = rest[near]
                out.extend((int(u), int(v)) for v in found)
                front.extend(found)
                rest = rest[~near]
    return out


def _compared(bits: int, limit: int):
    """Links within each key; rows come sorted by key. Keys of more than ``limit`` rows pass through, numbered."""

    def put(out: list, key: int, group: np.ndarray) -> None:
        out.extend((None, *link) for link in forest(group, bits))

    def batch_of(out: list) -> pa.RecordBatch:
        keys, a, b = zip(*out, strict=True)
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64) if len(x) else x, pa.int64())
        return pa.record_batch({"key": pa.array(keys, pa.int64()), "a": signed(a), "b": signed(b)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, passed = None, np.zeros(0, np.int64), 0
        for batch in batches:
            keys, prints = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(keys)][: len(first)]
            out: list = []
            two = np.flatnonzero((last - first == 2)[1:-1]) + 1 if len(first) > 2 else np.zeros(0, np.int64)
            u, v = prints[first[two]].view(np.uint64), prints[first[two] + 1].view(np.uint64)
            near = np.bitwise_count(u ^ v) <= bits
            out += [(None, a, b) for a, b in zip(u[near].tolist(), v[near].tolist(), strict=True)]
            more = np.flatnonzero(last - first != 2)
            more = np.unique(np.r_[more[last[more] - first[more] > 2], [0, len(first) - 1][: len(first)]]) if len(first) else more
            for g in more.tolist():
                mine = prints[first[g] : last[g]]
                if keys[first[g]] == key:
                    kept = np.concatenate([kept, mine])
                else:
                    if passed:
                        out += [(key, int(x), passed + i) for i, x in enumerate(kept.view(np.uint64))]
                    else:
                        put(out, key, kept)
                    key, kept, passed = keys[first[g]], mine, 0
                if limit and len(kept) > limit:
                    out += [(int(key), int(x), passed + i) for i, x in enumerate(kept.view(np.uint64))]
                    passed, kept = passed + len(kept), kept[:0]
            if out:
                yield batch_of(out)
        out = [(int(key), int(x), passed + i) for i, x in enumerate(kept.view(np.uint64))] if passed else []
        if not passed:
            put(out, key, kept)
        if out:
            yield batch_of(out)

    return run


def fingerprint_links(prints: DataFrame, bits: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links a, b that join exactly what differences of at most ``bits`` (3 or fewer) bits join; ``prints`` has distinct fp."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find up to three differing bits")
    n = partitions(prints.sparkSession)
    schema = "key long, a long, b long"
    keyed = prints.select("fp").mapInArrow(_keys, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    found = materialize(keyed.mapInArrow(_compared(bits, bucket), schema), "simhash")
    links = found.where(F.col("key").isNull()).select("a", "b")
    large = found.where(F.col("key").isNotNull()).select("key", F.col("a").alias("fp"), F.floor(F.col("b") / bucket).alias("block"))
    if not large.isEmpty():
        last = large.groupBy("key").agg(F.max("block").alias("last"))
        paired = large.join(last, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
        paired = paired.select("fp", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"))
        dealt = paired.distinct().repartition(n, "key").sortWithinPartitions("key")
        links = links.unionByName(dealt.mapInArrow(_compared(bits, 0), schema).select("a", "b"))
    return links


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, fp long")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3) -> DataFrame:
    """Every document's doc_id, fp and component_id: the smallest doc_id reachable over links of at most ``bits`` bits.

    Cases: null, empty and wordless texts have fingerprint 0 and are linked with each other and with whatever is within
    ``bits`` of 0; texts of fewer words than a shingle are one shingle; repeated rows are linked like other equal texts;
    a null doc_id is never the smallest unless its component has no other; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = connected_components(fingerprint_links(distinct, bits))
    rooted = distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
