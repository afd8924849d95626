"""Token-id files (operator 10): frequency-ranked ids in byte-aligned variable-length code.

A shard is a run of blocks. A block holds its documents' ids and lengths, then one control
byte for every four ids (two bits each: the code's length less one), then the codes' bytes.
Ids are replaced by their rank among all ids by descending count, so frequent ids take a byte.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, new_path, null_safe_long, range_bounds, store, text_buffer
from .tokens import encoder

MAGIC = np.uint64(0x314B4C4254444943)
MISSING = np.iinfo(np.int64).min
_IDS = "part int, doc_id long, n long, ids binary"
_SHARD = "part int, name string, docs long, ids long"
_DOCS = "doc_id long, start long, n_tokens long, ids binary"
_LEN = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_block(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and code bytes of non-negative integers below 2**32."""
    r = ranks.astype(np.uint32)
    size = 1 + (r > 0xFF).astype(np.int64) + (r > 0xFFFF) + (r > 0xFFFFFF)
    control = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    control[: len(r)] = size - 1
    control = (control.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        m = size > k
        if not m.any():
            break
        data[at[m] + k] = r[m] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control, data


def decode_block(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The integers back, with the lengths looked up by control byte."""
    size = _LEN[control].reshape(-1)[:n]
    at = np.cumsum(size) - size
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        m = size > k
        if not m.any():
            break
        out[m] |= data[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _flat(raw: np.ndarray, off: np.ndarray, n: np.ndarray) -> np.ndarray:
    wide = np.diff(off) != 2 * n
    if wide.any():
        return np.concatenate([np.frombuffer(raw[o + 1 : e], "<u4") if w else np.frombuffer(raw[o:e], "<u2").astype("<u4") for o, e, w in zip(off[:-1], off[1:], wide)])
    return np.frombuffer(raw, "<u2").astype("<u4")


def _files(target: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, on driver and executors alike: local, HDFS or an object store, whose
    Hadoop names stand for the same one here."""
    scheme, mark, rest = target.partition("://")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}.get(scheme, scheme) + mark + rest)


def write_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, rows_a_shard: int = 4000, most_shards: int = 20_000, target: str | None = None) -> tuple[str, list, np.ndarray]:
    """Encode all texts and write them as shards in ascending ``id_col`` order.

    Documents are range-partitioned on cut points of the id column (``rows_a_shard`` rows each, or
    more where they would be over ``most_shards``; one row a shard reaches the driver), sorted within a shard and streamed to it block by block. A task writes under its
    attempt's name, and the manifest names the attempt that counted, so lost or repeated tasks
    do no harm. Returns the folder, the manifest rows and the rank-to-id table (the vocabulary's
    size at most). Null text: the end id alone. Null ids come first and read back as null.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    target = target or new_path(spark, "idfile")
    src = docs.select(null_safe_long(id_col, MISSING).alias("doc_id"), F.col(text_col).alias("text"))
    count = src.count()
    shards = max(1, min(most_shards, -(-count // rows_a_shard)))
    bounds = range_bounds(src, "doc_id", shards)
    shards, schema = len(bounds) + 1, arrow_schema(_IDS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, "word"), np.array([end_id], np.uint32)
        for b in batches:
            part = np.searchsorted(bounds, b.column(0).to_numpy(), "left")
            rows, size = [], 0
            for p, doc, text in zip(part.tolist(), b.column(0).to_pylist(), (x.as_py() for x in b.column(1))):
                ids = np.concatenate([enc.encode(text or ""), end]).astype("<u4")
                packed = ids.astype("<u2").tobytes() if int(ids.max()) < 65536 else b"\1" + ids.tobytes()
                rows.append((p, doc, len(ids), packed))
                size += len(packed)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    coded = store(src.mapInArrow(encode, _IDS), "ids")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(0, np.int64)
        for b in batches:
            c = np.bincount(_flat(*text_buffer(b.column(1)), b.column(0).to_numpy()))
            if len(c) > len(got):
                got, c = c.astype(np.int64), got
            got[: len(c)] += c
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], names=["id", "c"])

    counts = coded.select("n", "ids").mapInArrow(tally, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    order = counts.sort_values(["c", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    ranks = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, out, docs_n, ids_n = f"shard-{task.partitionId():08d}-{task.taskAttemptId()}.bin", None, 0, 0
        files, root = _files(target)
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                files.create_dir(root, recursive=True)
                out = files.open_output_stream(posixpath.join(root, name))
            n = b.column(1).to_numpy()
            control, data = encode_block(ranks.value[_flat(*text_buffer(b.column(2)), n)])
            out.write(np.array([MAGIC, len(n), n.sum(), len(data)], "<u8").tobytes())
            for x in (b.column(0).to_numpy().astype("<i8"), n.astype("<i8"), control, data):
                out.write(x.tobytes())
            docs_n, ids_n = docs_n + len(n), ids_n + int(n.sum())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([name]), pa.array([docs_n]), pa.array([ids_n])], schema=arrow_schema(_SHARD))

    manifest = coded.repartitionById(shards, F.col("part")).sortWithinPartitions("doc_id", "n", "ids").select("doc_id", "n", "ids").mapInArrow(write, _SHARD).collect()
    return target, sorted(manifest, key=lambda r: r.part), order


def read_ids(spark, target: str, manifest: list, order: np.ndarray) -> DataFrame:
    """Documents back from the shards: doc_id, start (ids before it), n_tokens, ids (little-endian uint32)."""
    table = spark.sparkContext.broadcast(order.astype("<u4"))
    rows, at = [], 0
    for r in manifest:
        rows.append((r.name, at))
        at += r.ids
    schema = arrow_schema(_DOCS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(target)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_input_stream(posixpath.join(root, name)) as f:
                    while head := f.read(32):
                        magic, docs_n, ids_n, size = (int(x) for x in np.frombuffer(head, "<u8"))
                        if magic != int(MAGIC):
                            raise ValueError(f"{name} is not a token-id shard")
                        doc, n = np.frombuffer(f.read(8 * docs_n), "<i8"), np.frombuffer(f.read(8 * docs_n), "<i8")
                        control, data = np.frombuffer(f.read(-(-ids_n // 4)), np.uint8), np.frombuffer(f.read(size), np.uint8)
                        ids = table.value[decode_block(control, data, ids_n)]
                        off = np.concatenate([[0], np.cumsum(n)])
                        packed = pa.BinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((off * 4).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == MISSING), pa.array(off[:-1] + start), pa.array(n), packed], schema=schema)
                        start += ids_n

    parts = spark.createDataFrame(rows, "name string, start long")
    return parts.repartition(max(1, len(rows))).mapInArrow(read, _DOCS)


def token_file(docs: DataFrame, **options) -> DataFrame:
    """``write_ids`` and then ``read_ids``: what the files hold, a row a document.

    Empty table: no row. Repeated doc_ids keep all their rows, ordered by length and ids. Other
    columns are not read.
    """
    return read_ids(docs.sparkSession, *write_ids(docs, **options))
