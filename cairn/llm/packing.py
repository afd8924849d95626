"""Packing: concatenate and cut (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, store, text_buffer
from .tokens import encoder

_IDS = "part int, local_start long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, tokenizer: str | None = None, end_id: int = 0, parts_limit: int = 4_000_000) -> DataFrame:
    """Sequences of ``length`` ids, cut from the concatenation of all documents.

    First pass: every partition encodes its documents and writes ids with the offset inside
    the partition. Second pass: exclusive prefix sums over the partitions' totals (one number
    a partition, at most ``parts_limit``) give global offsets; windows of ``length`` ids are
    then plain arithmetic on a row, and a document that crosses a window's or a partition's
    edge gives one boundary record on each side. No text or id is shuffled. Only the last
    sequence can be short.

    Returns a row a piece: doc_id, start, length, doc_tokens, sequence_id, offset and
    ids (little-endian uint32). Null or empty text: the end id alone. A null doc_id stays null;
    repeated rows are packed as often as they occur; an empty table gives no row. Other
    columns of ``docs`` are not read.
    """
    path = tokenizer or default_tokenizer()
    schema = arrow_schema(_IDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path, "byte"), TaskContext.get().partitionId(), 0
        end = np.array([end_id], np.uint32)
        for b in batches:
            rows, size = [], 0
            for doc, text in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                ids = np.concatenate([enc.encode(text or ""), end]).astype("<u4")
                packed = ids.astype("<u2").tobytes() if end_id < 65536 and int(ids.max()) < 65536 else b"\1" + ids.tobytes()
                rows.append((part, at, doc, len(ids), packed))
                at += len(ids)
                size += len(packed)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    ids = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, _IDS), "pack")
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").limit(parts_limit + 1).collect()
    if len(totals) > parts_limit:
        raise ValueError(f"more than {parts_limit} partitions; coalesce the input")
    base, total = {}, 0
    for row in totals:
        base[row.part] = total
        total += row.n
    bases = docs.sparkSession.sparkContext.broadcast(base)
    pieces = arrow_schema(_PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = bases.value
        for b in batches:
            n = b.column(3).to_numpy()
            first = np.array([at[p] for p in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            count = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), count)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (first // length)[row]
            start = np.maximum(seq * length - first[row], 0)
            stop = np.minimum((seq + 1) * length - first[row], n[row])
            offset = first[row] + start - seq * length
            raw, off = text_buffer(b.column(4))
            wide = np.diff(off) != 2 * n  # ids beyond two bytes are kept in four, behind a mark
            if wide.any():
                flat = np.concatenate([np.frombuffer(raw[o + 1 : e], "<u4") if w else np.frombuffer(raw[o:e], "<u2").astype("<u4") for o, e, w in zip(off[:-1], off[1:], wide)])
            else:
                flat = np.frombuffer(raw, "<u2").astype("<u4")
            sizes = (stop - start) * 4
            data = pa.BinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(2).take(pa.array(row)), pa.array(start), pa.array(stop - start), pa.array(n[row]), pa.array(seq), pa.array(offset), data], schema=pieces)

    return ids.mapInArrow(cut, _PIECES)
