"""Documents kept in compressed files of the shared folder, so that answers can go back to where a text lies.

A task writes its documents, chunk by chunk, into files of its own and hands on what it found in them together with the
file's number (part) and name. A file has a new name for each attempt; the table of what was found, which Spark commits,
names only what counts. Later passes deal rows out by part and read each file in turn, so texts are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, discard, file_system, remove, utf8


class Writer:
    """One spool file of a task."""

    def __init__(self, folder: str, part: int, schema: pa.Schema) -> None:
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        self.part, self.name, self.rows = part, uuid.uuid4().hex, 0
        self.out = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.writer = pa.ipc.new_stream(self.out, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3)))

    def put(self, chunk: pa.RecordBatch) -> None:
        self.writer.write_batch(chunk)
        self.rows += len(chunk)

    def close(self) -> None:
        self.writer.close()
        self.out.close()


def written(batches: Iterator[pa.RecordBatch], folder: str, schema: pa.Schema, size: int, kind: type[Writer]) -> Iterator[pa.RecordBatch]:
    """What ``kind`` (its add, finish and full) hands on of all batches, in chunks of about ``size`` bytes of text."""
    file, part = None, TaskContext.get().partitionId()
    for batch in batches:
        _, offs = utf8(batch.column("text"))
        for lo, hi in chunks(offs, size):
            if file is None:
                file = kind(folder, part, schema)
                part += 1 << 20
            yield from file.add(pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo) for c in schema.names], schema=schema))
            if file.full():
                yield from file.finish()
                file = None
    if file is not None:
        yield from file.finish()


def read(folder: str, name: str) -> Iterator[pa.RecordBatch]:
    """The chunks of a spool file, as they were written."""
    system, path = file_system(folder)
    with system.open_input_stream(f"{path}/{name}", compression=None) as file, pa.ipc.open_stream(file) as reader:
        yield from reader


def grouped(batches: Iterator[pa.RecordBatch], key: str = "part") -> Iterator[tuple[int, pa.Table]]:
    """Rows of each value of ``key``; they come sorted by it."""
    value, kept = None, []
    for batch in batches:
        values = batch.column(key).to_numpy()
        edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(batch) else [0]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if values[lo] != value and kept:
                yield value, pa.Table.from_batches(kept)
                kept = []
            value = int(values[lo])
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield value, pa.Table.from_batches(kept)


@dataclass(frozen=True)
class Spool:
    """Documents in files of ``folder``; ``table`` has what was found in them, with part and file."""

    folder: str
    table: DataFrame
    parts: int

    def dealt(self, rows: DataFrame, *order: str) -> DataFrame:
        """Rows that have a part, all of one part in one task, sorted by it. Parts are spread evenly."""
        return rows.repartitionById(self.parts, F.pmod("part", F.lit(self.parts)).cast("int")).sortWithinPartitions("part", *order)

    def remove(self) -> None:
        discard(self.table)
        remove(self.table.sparkSession, self.folder)
