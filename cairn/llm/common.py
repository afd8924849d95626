"""Shared helpers: Arrow text buffers, shared storage, packed words, key ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop_path, new_path

#: Text handled by one vectorised step; a longer single text is one step by itself.
STEP_BYTES = 2 << 20

def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the table behind ``store``'s result, once no plan reads it any more."""
    spark = df.sparkSession
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        if "/cairn-" in f:
            drop_path(spark, f)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = col.cast(pa.large_binary())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, text: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_BYTE = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[32, 9, 10, 11, 12, 13]] = 0
_POW = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15, np.uint64))
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


def piece_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, keep_space: bool = False) -> np.ndarray:
    """64-bit hash of each byte range; ranges are ascending, disjoint and not empty."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = int(start[0])
    raw = raw[first : int(end[-1])]
    start, end = start - first, end - first
    pos = np.arange(len(raw), dtype=np.int64)
    pos -= np.repeat(start, np.diff(np.append(start, len(raw))))
    value = _BYTE[raw]
    if keep_space:
        value[value == 0] = raw[value == 0].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    value *= _POW[pos & 0xFFFF]
    if len(pos) and int(pos.max()) >> 16:
        value *= (pos >> 16).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.add.reduceat(value, start)
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts: start, end, and n+1 word offsets of the texts."""
    inside = ~_SEP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    up = (raw >= 65) & (raw <= 90)
    return raw + (up.astype(np.uint8) << 5)


def to_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def null_safe_long(name: str, missing: int) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(missing))


def range_bounds(df: DataFrame, key: str, parts: int) -> np.ndarray:
    """``parts - 1`` cut points of a long column at about equal row counts (one scan of that column)."""
    if parts < 2:
        return np.zeros(0, np.int64)
    got = df.select(F.col(key).cast("double").alias("k")).where("k is not null").approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return np.unique(np.array(got, dtype=np.float64).astype(np.int64))


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow schema of a flat Spark DDL string."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ", 1) for x in ddl.split(","))])


def input_partitions(df: DataFrame, per: int = 1) -> int:
    """Shuffle partitions that the session asks for."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // per)


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: str | None = None) -> Callable:
    """A mapInArrow function from one over batches, cut to STEP_BYTES where ``text`` is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in steps(b, text) if text else [b]:
                out = fn(s)
                if out is not None and out.num_rows:
                    yield out

    return run


class IdFilter:
    """A Bloom filter of a long column with a fixed size: 2**26 bits, whatever the table holds.

    Tasks set bits in 32,768-bit pieces, which are OR-ed by piece; at most 2,048 pieces (8 MB)
    come to the driver and are broadcast. It may let other ids pass (all of them, when it is
    overfull), but never holds one back, so what follows must still join.
    """

    BITS, PIECE = 1 << 26, 1 << 15

    def __init__(self, ids: DataFrame, column: str) -> None:
        bits, piece = self.BITS, self.PIECE

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.concatenate(_probes(b.column(0).to_numpy(), bits)) for b in batches)]))
            group, start = np.unique(at // piece, return_index=True)
            maps = []
            for s, e in zip(start, np.append(start[1:], len(at))):
                m = np.zeros(piece, np.uint8)
                m[at[s:e] % piece] = 1
                maps.append(np.packbits(m, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(maps, pa.binary())], names=["g", "m"])

        marked = ids.select(column).where(F.col(column).isNotNull()).mapInArrow(mark, "g long, m binary")
        self.bitmap = np.zeros(bits // 8, np.uint8)
        for r in marked.groupBy("g").agg(F.bitmap_or_agg("m").alias("m")).collect():
            self.bitmap[r.g * (piece // 8) : (r.g + 1) * (piece // 8)] = np.frombuffer(r.m, np.uint8)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        ok = np.ones(len(ids), bool)
        for at in _probes(ids, self.BITS):
            ok &= (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return ok


def _probes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return [(h & np.uint64(bits - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)]
