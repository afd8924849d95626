"""Content-defined chunking: a gear rolling hash, vectorised over whole objects.

The hash of a position covers the 64 bytes before it, so it is built by doubling in six array
steps instead of a loop over bytes. Cut points need two masks (normalised chunking): a strict one
below the average size and a loose one above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_AVERAGE = 256 * 1024
_ROWS, _BYTES = 8192, 8 << 20  # of one batch that goes out
_GEAR = np.random.default_rng(0x5EED).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Chunker:
    """Chunks of average size ``average``; a quarter of it at least (but the last) and four times at most."""

    average: int = DEFAULT_AVERAGE

    def __post_init__(self) -> None:
        if self.average < 4:
            raise ValueError("the average chunk size must be at least 4 bytes")

    @property
    def least(self) -> int:
        return max(1, self.average // 4)

    @property
    def most(self) -> int:
        return self.average * 4

    def cuts(self, data: bytes | np.ndarray) -> np.ndarray:
        """Ends of the chunks; none for no data."""
        raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64)
        if n <= self.least:
            return np.array([n])
        strict, loose = self._candidates(raw)
        ends, at = [], 0
        while n - at > self.least:
            low, mid, top = at + self.least, min(at + self.average, n), min(at + self.most, n)
            i = np.searchsorted(strict, low)
            if i < len(strict) and strict[i] < mid:
                cut = int(strict[i])
            else:
                j = np.searchsorted(loose, max(mid, low))
                cut = int(loose[j]) if j < len(loose) and loose[j] < top else top
            ends.append(cut)
            at = cut
        if at < n:
            ends.append(n)
        return np.array(ends, np.int64)

    def _candidates(self, raw: np.ndarray, span: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        bits = max(1, int(self.average).bit_length() - 1)
        tight, wide = min(bits + 2, 62), max(bits - 2, 1)
        strict, loose = [], []
        for a in range(0, len(raw), span):
            start = max(0, a - 63)
            h = _GEAR[raw[start : a + span]]
            for k in range(6):
                step = 1 << k
                h[step:] += h[:-step] << np.uint64(step)
            h = h[a - start :]
            found = np.flatnonzero(h >> np.uint64(64 - wide) == 0)
            loose.append(found + a + 1)
            strict.append(found[h[found] >> np.uint64(64 - tight) == 0] + a + 1)
        return np.concatenate(strict), np.concatenate(loose)

    def split(self, data: bytes) -> list[bytes]:
        ends = self.cuts(data).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def content_chunks(objects: DataFrame, average: int = DEFAULT_AVERAGE, content: str = "content", with_payload: bool = True) -> DataFrame:
    """Content-defined chunks of every object: the other columns, seq, offset, length, chunk_id, payload.

    Arrow batches stream through; an object is chunked where it lies, nothing is shuffled. What a task
    holds besides its batch is bounded: rows go out at _ROWS chunks or _BYTES of payload. Null and
    empty contents give no chunk.
    """
    chunker = Chunker(average)
    rest = [c for c in objects.columns if c != content]
    base = objects.select(*rest, content)
    fields = [*base.schema.fields[:-1], T.StructField("seq", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("chunk_id", T.StringType())]
    out = T.StructType([*fields, T.StructField("payload", T.BinaryType())] if with_payload else fields)
    width = 5 if with_payload else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, cols, size = [], [[] for _ in range(width)], 0

            def flush():
                own = [b.column(i).take(pa.array(row, pa.int64())) for i in range(len(rest))]
                made = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                return pa.RecordBatch.from_arrays([*own, *made], names=out.names)

            for i, value in enumerate(b.column(len(rest))):
                data = memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")
                at = 0
                for seq, end in enumerate(chunker.cuts(data).tolist()):
                    part = data[at:end]
                    for c, v in zip(cols, (seq, at, end - at, "sha256:" + hashlib.sha256(part).hexdigest())):
                        c.append(v)
                    if with_payload:
                        cols[4].append(bytes(part))
                        size += end - at
                    row.append(i)
                    at = end
                    if size > _BYTES or len(row) >= _ROWS:
                        yield flush()
                        row, cols, size = [], [[] for _ in range(width)], 0
            if row:
                yield flush()

    return base.mapInArrow(run, out)


def chunk_udtf(average: int = DEFAULT_AVERAGE):
    """A table function for SQL: ``SELECT ... FROM objects, LATERAL chunk(content)``."""
    from pyspark.sql.functions import udtf

    chunker = Chunker(average)

    class Chunks:
        def eval(self, content):
            at, data = 0, bytes(content or b"")
            for seq, end in enumerate(chunker.cuts(data).tolist()):
                part = data[at:end]
                yield seq, at, end - at, "sha256:" + hashlib.sha256(part).hexdigest(), part
                at = end

    return udtf(Chunks, returnType="seq int, offset long, length long, chunk_id string, payload binary")
