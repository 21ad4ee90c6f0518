"""Exact dedup by Patricia-trie owners.

Texts go to partitions by length and content hash. Each partition inserts full byte strings into compressed radix tries
whose terminal nodes hold the owner's identifier and counts, so equality is decided on the bytes themselves. Before the
shuffle every task inserts its own texts the same way and sends one row a distinct text, so a text with very many copies
is as cheap as any other. A trie that outgrows its memory goes down to where its strings part, writes the heaviest
subtrees there, and whatever would later be inserted below them, to files of its own in the shared folder, and finishes
each of them afterwards in a trie of its own.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chosen, file_system, fresh_path, materialize, partitions, released, utf8

#: Bytes that a trie keeps in memory, and what a node takes beside its label.
TRIE_BYTES, NODE_BYTES = 96 << 20, 320
#: A pre-aggregating task sends what it has when its trie reaches this.
LOCAL_BYTES = 48 << 20

_SIZE = struct.Struct("<Q")
#: A distinct string with its owner, how many rows the owner has and how many rows there are.
Entry = tuple[bytes, int | None, int, int]


class _Node:
    __slots__ = ("label", "below", "owner", "own", "count", "file")

    def __init__(self, label: bytes, owner: int | None = None, own: int = 0, count: int = 0) -> None:
        self.label, self.owner, self.own, self.count, self.below, self.file = label, owner, own, count, {}, None

    def add(self, owner: int | None, own: int, count: int) -> None:
        if not self.count or (owner is not None and (self.owner is None or owner > self.owner)):
            self.owner, self.own = owner, own
        elif owner == self.owner:
            self.own += own
        self.count += count


class _Spill:
    """Entries below one node, written to a file and read back once."""

    def __init__(self, folder: str) -> None:
        self.system, path = file_system(folder)
        self.system.create_dir(path, recursive=True)
        self.path = f"{path}/{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.path, compression=None)

    def add(self, entry: Entry) -> None:
        packed = pickle.dumps(entry, protocol=5)
        self.out.write(_SIZE.pack(len(packed)))
        self.out.write(packed)

    def entries(self) -> Iterator[Entry]:
        self.out.close()
        with self.system.open_input_stream(self.path, compression=None) as file:
            while head := file.read(_SIZE.size):
                yield pickle.loads(file.read(_SIZE.unpack(head)[0]))
        self.system.delete_file(self.path)


class PatriciaTrie:
    """Byte strings with an owner (the largest identifier seen) and counts, in a compressed radix trie.

    ``folder`` is where subtrees go when the trie takes more than ``limit`` bytes; without one it only grows.
    """

    def __init__(self, limit: int = TRIE_BYTES, folder: str | None = None) -> None:
        self.limit, self.folder, self.size, self.root = limit, folder, 0, _Node(b"")
        self.most = limit

    def insert(self, key: bytes, owner: int | None, own: int = 1, count: int = 1) -> None:
        node, at, n = self.root, 0, len(key)
        while True:
            if at == n:
                node.add(owner, own, count)
                return
            child = node.below.get(key[at])
            if child is None:
                node.below[key[at]] = _Node(key[at:], owner, own, count)
                self.size += n - at + NODE_BYTES
                break
            if child.file is not None:
                child.file.add((key[at:], owner, own, count))
                return
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = _common(label, key[at : at + len(label)])
            fork = _Node(label[:same])
            child.label = label[same:]
            fork.below[child.label[0]] = child
            node.below[key[at]] = fork
            self.size += NODE_BYTES
            node, at = fork, at + same
        if self.folder is not None and self.size > self.most:
            self._spill()

    def _spill(self) -> None:
        """Write the heaviest subtrees below the first fork to files, until half the limit is left."""
        node, path = self.root, 0
        while len(node.below) == 1 and path <= self.limit // 2:
            (child,) = node.below.values()
            if child.file is not None:
                break
            node, path = child, path + len(child.label) + NODE_BYTES
        weights = {b: sum(len(x.label) + NODE_BYTES for x, _ in _nodes(c, b"")) for b, c in node.below.items() if c.file is None}
        for byte in sorted(weights, key=weights.get, reverse=True):
            if self.size <= self.limit // 2:
                break
            out = _Spill(self.folder)
            for x, prefix in _nodes(node.below[byte], b""):
                if x.file is not None:  # what was spilled further down moves up
                    for key, *rest in x.file.entries():
                        out.add((prefix + key, *rest))
                elif x.count:
                    out.add((prefix + x.label, x.owner, x.own, x.count))
            stub = _Node(bytes([byte]))
            stub.file, node.below[byte] = out, stub
            self.size -= weights[byte] - 1 - NODE_BYTES
        self.most = max(self.limit, 2 * self.size)

    def entries(self) -> Iterator[Entry]:
        """Every distinct string with owner and counts; the trie is empty afterwards."""
        todo: list[tuple[bytes, PatriciaTrie | _Spill]] = [(b"", self)]
        while todo:
            prefix, of = todo.pop()
            if isinstance(of, _Spill):
                # Strings of a spilled subtree may outgrow memory again; the next trie forks further down.
                trie = PatriciaTrie(self.limit, self.folder)
                for entry in of.entries():
                    trie.insert(*entry)
                of = trie
            for node, before in _nodes(of.root, prefix):
                if node.file is not None:
                    todo.append((before, node.file))
                elif node.count:
                    yield before + node.label, node.owner, node.own, node.count
            of.root, of.size = _Node(b""), 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings that differ."""
    n = min(len(a), len(b))
    if n < 32:
        return next((i for i in range(n) if a[i] != b[i]), n)
    differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    at = int(differ.argmax())
    return at if differ[at] else n


def _nodes(node: _Node, prefix: bytes) -> Iterator[tuple[_Node, bytes]]:
    """Every node with the string before its label. A node's string is made once, when its children are asked for."""
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        yield node, prefix
        if node.below:
            key = prefix + node.label
            stack.extend((x, key) for x in node.below.values())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
    for batch in batches:
        raw, offs = utf8(batch.column("text"))
        view = memoryview(raw)
        counts = [(1, 1)] * len(batch)
        if "n" in batch.schema.names:
            counts = zip(batch.column("own").to_pylist(), batch.column("n").to_pylist(), strict=True)
        for i, (owner, (own, n)) in enumerate(zip(batch.column("doc_id").to_pylist(), counts, strict=True)):
            yield bytes(view[offs[i] : offs[i + 1]]), owner, own, n


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = PatriciaTrie()
    for entry in _rows(batches):
        trie.insert(*entry)
        if trie.size > LOCAL_BYTES:
            yield from _packed(trie)
    yield from _packed(trie)


def _packed(trie: PatriciaTrie, bytes_at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for entry in trie.entries():
        kept.append(entry)
        size += len(entry[0])
        if size > bytes_at_once:
            yield _batch(kept)
            kept, size = [], 0
    if kept:
        yield _batch(kept)


def _batch(entries: list[Entry]) -> pa.RecordBatch:
    texts, owners, own, counts = zip(*entries, strict=True)
    return pa.record_batch({"text": pa.array(texts, pa.binary()), "doc_id": pa.array(owners, pa.int64()), "own": pa.array(own, pa.int64()), "n": pa.array(counts, pa.int64())})


def _owners(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(limit, folder)
        for entry in _rows(batches):
            trie.insert(*entry)
        kept: list[tuple[str, int | None, int, int]] = []
        for key, owner, own, count in trie.entries():
            kept.append((hashlib.sha256(key).hexdigest(), owner, own, count))
            if len(kept) == 10_000:
                yield _owner_batch(kept)
                kept = []
        if kept:
            yield _owner_batch(kept)

    return run


def _owner_batch(kept: list) -> pa.RecordBatch:
    shas, owners, own, counts = zip(*kept, strict=True)
    return pa.record_batch({"sha": pa.array(shas, pa.string()), "keep_id": pa.array(owners, pa.int64()), "keep_rows": pa.array(own, pa.int64()), "group_size": pa.array(counts, pa.int64())})


def owners(docs: DataFrame, limit: int = TRIE_BYTES) -> DataFrame:
    """One row a distinct text: sha (SHA-256, hex), keep_id (largest doc_id), keep_rows (rows that have both) and group_size."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    local = rows.mapInArrow(released(_local), "text binary, doc_id long, own long, n long")
    dealt = local.repartition(partitions(spark), F.length("text"), F.xxhash64("text"))
    return dealt.mapInArrow(released(_owners(fresh_path(spark, "tries"), limit)), "sha string, keep_id long, keep_rows long, group_size long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Every document with the one that stays of its text: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. The largest doc_id stays. Cases: rows that share both
    doc_id and text are one document and are marked alike (group_size counts rows); a null doc_id never wins against
    another, and in a group of nothing but null doc_ids keep_id is null and all are marked; an empty table gives no rows;
    other columns are left out.
    """
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), sha.alias("sha"))
    joined = rows.join(owners(docs), "sha")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each text, the one with the largest doc_id, with all its columns.

    Cases as in ``exact_duplicates``, but of rows that share both doc_id and text a single one stays.
    """
    stays = materialize(owners(docs).select("sha", "keep_id", F.col("keep_rows").alias("rows"), F.lit(1).alias("copies")), "owners")
    sha = F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256)
    return chosen(docs, [sha, docs["doc_id"].cast("long")], stays)
