"""Shared storage, partition counts and text chunks of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker turns into arrays at once.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessitura-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it, for Python workers."""
    if uri.startswith("file:") or uri.startswith("/"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^(file:)?/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", uri))


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has written to."""
    return f"{shared_dir(spark)}/tessitura/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    """Partitions for a shuffle of the corpus, as the session sets them for its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def identity(*columns: Column) -> Column:
    """SHA-256 of the columns' values, null apart from all others: names a row whatever its columns are called."""
    said = [F.coalesce(F.concat(F.lit("+"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def chosen(docs: DataFrame, keys: Sequence[Column], plan: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``plan`` asks for, with all their columns.

    ``plan`` has one row a key: as many columns as ``keys`` (compared in turn, null equal to null), then rows (how many rows
    of docs have the key) and copies (how many are wanted of them together). Of rows that share a key one stands for all;
    they are aggregated before they are shuffled, so a key with very many rows is no hot one.
    """
    n = len(keys)
    names = [f"key{i}" for i in range(n)]
    plan = plan.toDF(*[f"plan{i}" for i in range(n)], "rows", "copies").where(F.col("copies") > 0)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[k.alias(name) for k, name in zip(keys, names, strict=True)])
    same = [F.col(name).eqNullSafe(F.col(f"plan{i}")) for i, name in enumerate(names)]
    one = whole.join(plan.where(F.col("rows") == 1), same).select("row", "copies")
    more = whole.join(plan.where(F.col("rows") > 1), same).groupBy(*names).agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    both = one.unionByName(more.select("row", "copies"))
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("row.*")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """``run``, giving memory back to the system when a task ends: Python workers live on for the stages after it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)

    return whole


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column, null as empty, without copying rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about ``limit`` bytes; a longer text makes a chunk of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; ``offsets`` are relative to ``data``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from each of n nodes to its component's least node, where that is another one."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


class SpanHasher:
    """64-bit polynomial hashes of many byte spans at once, from prefix sums over pieces of the bytes."""

    BASE = 0x9E3779B97F4A7C15
    #: Bytes of a piece; a longer span makes one of its own.
    PIECE = 1 << 20

    def __init__(self) -> None:
        self.inverse = pow(self.BASE, -1, 1 << 64)
        self.table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
        self.powers = self.unpowers = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers))
            ones = np.ones(size, np.uint64)
            ones[1:] = np.uint64(self.BASE)
            self.powers = np.multiply.accumulate(ones)
            ones[1:] = np.uint64(self.inverse)
            self.unpowers = np.multiply.accumulate(ones)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each span; spans come in order and don't overlap."""
        out, lo = np.empty(len(starts), np.uint64), 0
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + self.PIECE, side="right")))
            part = data[base : ends[hi - 1]]
            n = len(part)
            self._grow(n + 1)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[part] * self.powers[:n], out=prefix[1:])
            first, last = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mix64((prefix[last] - prefix[first]) * self.unpowers[first])
            lo = hi
        return out
