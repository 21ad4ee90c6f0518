"""WARC archives: written with an index first, read back by coalesced byte ranges.

A task writes its records one after another, each a gzip member of its own, into archives of bounded size in the shared
folder, and hands on where each lies. These rows are the index (file, offset, length, unpacked size, URL, digest), written
as a table before anything is read. An archive has a name of its own for each attempt, so a task that runs again writes
another file and the index, which Spark commits, names only what counts. Reading goes from the index: selected records are
sorted by file and offset, neighbouring ranges are joined into reads of bounded length, and the records of a read are
unpacked one after another, parsed and their payloads hashed anew. What a task holds is bounded by unpacked bytes: one
read, one record and one batch of results.

Which record is a response is found on digests and identifiers alone. The html then meets the list of revisits by page_id
and digest, so a payload that very many pages share is spread like any other.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import file_system, fresh_path, materialize, partitions, utf8

#: Wanted size of an archive in bytes.
ARCHIVE_BYTES = 128 << 20
#: Payloads below this are never written as revisits.
REVISIT_BYTES = 100
#: One read spans gaps up to GAP and grows to READ_BYTES at most, unless a record alone is longer.
GAP, READ_BYTES = 64 << 10, 4 << 20
#: Unpacked bytes of records that are handed on at once.
BATCH_BYTES = 4 << 20
#: What ends a header and a record.
END = "\r\n\r\n"
INDEX = "page_id long, url string, digest string, file string, offset long, length long, unpacked long"
DATE = "2024-01-01T00:00:00Z"


def _clean(column: Column) -> Column:
    """A header value: white space and control characters would end it."""
    return F.regexp_replace(column, r"[\x00-\x20\x7F]", "%20")


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """One WARC record a page: page_id, url, digest and record (its text).

    Of equal payloads of at least ``revisit_bytes`` the smallest page_id is a response and the others revisit it.
    """
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("digest"))
    names = rows.where(F.col("bytes") >= revisit_bytes).groupBy("page_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = names.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).where(F.col("pages") > 1)
    later = names.join(first, (F.col("digest") == F.col("d")) & ~F.col("page_id").eqNullSafe(F.col("first")))
    later = later.select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first")
    rows = rows.join(later, rows["page_id"].eqNullSafe(later["later_id"]) & (rows["digest"] == later["later_digest"]), "left")
    revisit = F.col("later_digest").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _clean(F.col("url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string")),
        F.lit(END),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("body")), F.lit(END))
    return rows.select("page_id", "url", "digest", record.alias("record"))


def _written(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                raw, offs = utf8(batch.column("record"))
                view = memoryview(raw)
                names, offsets, lengths = [], [], []
                for i in range(len(batch)):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        else:
                            system.create_dir(path, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    names.append(name)
                    offsets.append(at)
                    for piece in (packer.compress(view[offs[i] : offs[i + 1]]), packer.flush()):
                        out.write(piece)
                        at += len(piece)
                    lengths.append(at - offsets[-1])
                yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "digest": batch.column("digest"), "file": pa.array(names, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64()), "unpacked": pa.array(np.diff(offs))})
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write ``path/data`` (archives) and ``path/index`` (parquet); returns the index as read back.

    Index: page_id, url, digest, file, offset, length, unpacked (bytes of the record).
    """
    made = records(pages, revisit_bytes)
    index = made.select(F.col("page_id").cast("long").alias("page_id"), "url", "digest", "record").mapInArrow(_written(f"{path}/data", archive_bytes), INDEX)
    index.write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


_FIELD = re.compile(rb"\r\n([A-Za-z-]+): ([^\r\n]*)")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record with its end."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.decode(): v.decode() for k, v in _FIELD.findall(head)}
    size = int(fields["Content-Length"])
    if not head.startswith(b"WARC/1.") or rest[size:] != END.encode():
        raise ValueError("the index does not point to a WARC record")
    return fields, rest[:size]


def coalesced(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Row ranges [lo, hi) of records, sorted by offset, that are read at once."""
    out, lo = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] > offsets[i - 1] + lengths[i - 1] + gap or offsets[i] + lengths[i] - offsets[lo] > most:
            out.append((lo, i))
            lo = i
    return out


def _read(folder: str, with_payload: bool, batch_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        rows, held = [], 0
        for batch in batches:
            files = batch.column("file").to_pylist()
            offsets, lengths, unpacked = (batch.column(c).to_numpy() for c in ("offset", "length", "unpacked"))
            edges = [i for i in range(len(files) + 1) if i in (0, len(files)) or files[i] != files[i - 1]]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                with system.open_input_file(f"{path}/{files[lo]}") as file:
                    for a, b in coalesced(offsets[lo:hi], lengths[lo:hi]):
                        start = int(offsets[lo + a])
                        raw = memoryview(file.read_at(int(offsets[lo + b - 1] + lengths[lo + b - 1]) - start, start))
                        for i in range(lo + a, lo + b):
                            at = int(offsets[i]) - start
                            rows.append(_parsed(zlib.decompress(raw[at : at + int(lengths[i])], 31, int(unpacked[i])), with_payload))
                            held += int(unpacked[i]) if with_payload else 1 << 10
                            if held >= batch_bytes:
                                yield _batch(rows, with_payload)
                                rows, held = [], 0
        if rows:
            yield _batch(rows, with_payload)

    return run


def _page(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _parsed(raw: bytes, with_payload: bool) -> tuple:
    fields, payload = parse_record(raw)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload and digest of {fields['WARC-Record-ID']} differ")
    row = (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), len(payload) if response else None, digest, fields["WARC-Type"], _page(fields.get("WARC-Refers-To")))
    return (*row, payload if response else None) if with_payload else row


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    columns = {n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=False)}
    if with_payload:
        columns["payload"] = columns["payload"].cast(pa.string())
    return pa.record_batch(columns)


def read_records(path: str, selected: DataFrame, *, with_payload: bool = True, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The records that ``selected`` rows of an index point to, parsed.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if ``with_payload``, payload. A
    revisit's payload_bytes and payload are null; they are those of the response it refers to. Without payloads they are
    unpacked and checked against their digests all the same, but don't leave the worker.
    """
    # A file's size is bounded, so all that is wanted of it fits one task; a task reads its files in turn.
    located = selected.select("file", "offset", "length", "unpacked")
    dealt = located.repartition(partitions(selected.sparkSession), "file").sortWithinPartitions("file", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    return dealt.mapInArrow(_read(f"{path}/data", with_payload, batch_bytes), schema)


def round_trip(pages: DataFrame, path: str | None = None, *, archive_bytes: int = ARCHIVE_BYTES, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages and read all records back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Cases: null html is an empty payload; a null URL leaves its header out, and white space or control characters in one
    are written as %20; pages alike in payload and page_id are all responses if theirs is the smallest page_id; a null
    page_id is read back as null and is never referred to unless no other page has the payload; an empty table makes no
    archives and gives no rows; other columns are left out.
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    index = write_archives(pages, path, archive_bytes, revisit_bytes)
    read = materialize(read_records(path, index, with_payload=False).drop("url"), "warc-read")
    sizes = read.where(F.col("record_type") == "response").groupBy(F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("full"))
    joined = read.join(sizes, F.col("payload_digest") == F.col("digest"))
    return joined.select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
