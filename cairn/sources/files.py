"""Binary files: whole files as objects, and the private segment and log formats read in parallel."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import content_type

PAGE_HEADER = struct.Struct("<Q32s32sIIII")
SEGMENT_MAGIC, SEGMENT_HEADER, PAGE_MAGIC, LOG_MAGIC = 0xB10B5EED, 128, 0xB10B5E00, 0x0BA1FACE
_PAGES = "segment string, page_offset long, length long, chunk_id string, blob_id string, seq long, total_chunks long, crc32 long, flags int, payload binary"
_LOG = "segment string, entry long, blob_id string, chunk_id string, chunk_segment long, chunk_offset long, length long, pos int"


def binary_files(spark: SparkSession, path: str, ns: str = "files", pattern: str | None = None) -> DataFrame:
    """Files below a folder as objects (ns, key, content, content_type, size, updated_at)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(F.lit(ns).alias("ns"), F.col("path").alias("key"), "content", content_type("content").alias("content_type"), F.col("length").alias("size"), F.col("modificationTime").alias("updated_at"))


def parse_segment(name: str, data: bytes) -> Iterator[tuple]:
    """A row a page. The scan stops quietly at the first unreadable header."""
    if len(data) < SEGMENT_HEADER:
        return
    (magic,), (page,) = struct.unpack_from("<I", data), struct.unpack_from("<I", data, 16)
    if magic != SEGMENT_MAGIC or page <= PAGE_HEADER.size:
        return
    at = SEGMENT_HEADER
    while at + PAGE_HEADER.size <= len(data):
        size, chunk, blob, seq, total, crc, word = PAGE_HEADER.unpack_from(data, at)
        if word & 0xFFFFFF00 != PAGE_MAGIC or size > page - PAGE_HEADER.size:
            return
        body = data[at + PAGE_HEADER.size : at + PAGE_HEADER.size + size]
        yield name, at, size, "sha256:" + chunk.hex(), "sha256:" + blob.hex(), seq, total, crc, word & 0xFF, body
        at += page


def parse_log(name: str, data: bytes) -> Iterator[tuple]:
    """A row a chunk of every complete entry; a torn last entry ends the scan."""
    at, entry = 0, 0
    while True:
        rows = []
        try:
            magic, n = struct.unpack_from("<IH", data, at)
            if magic != LOG_MAGIC:
                return
            blob = data[at + 6 : at + 6 + n]
            (count,) = struct.unpack_from("<I", data, at + 6 + n)
            here = at + 10 + n
            for pos in range(count):
                (m,) = struct.unpack_from("<H", data, here)
                chunk = data[here + 2 : here + 2 + m]
                segment, offset, length = struct.unpack_from("<QQQ", data, here + 2 + m)
                rows.append((name, entry, blob.decode(), chunk.decode(), segment, offset, length, pos))
                here += 26 + m
        except (struct.error, UnicodeDecodeError):
            return
        yield from rows
        at, entry = here, entry + 1


def _scan(spark: SparkSession, path: str, pattern: str, parse, ddl: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows: list[tuple] = []
                for row in parse(name, data.as_py()):
                    rows.append(row)
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return files.mapInArrow(run, ddl)


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """Pages of all segment files below a folder, one task a file."""
    return _scan(spark, path, "seg-*.vol", parse_segment, _PAGES)


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all write-ahead logs below a folder; no file gives no row."""
    return _scan(spark, path, "seg-*.wal", parse_log, _LOG)

