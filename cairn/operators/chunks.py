"""Chunking, chunk-level deduplication, reassembly and byte ranges.

Tables: objects (ns, key, content); object chunks (ns, key, blob_id, seq, offset, length,
chunk_id, payload). Hashes are over plain bytes; deduplication never crosses a namespace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blob_id, chunk_id

PAGE, HEADER = 16384, 88


def fixed_chunks(objects: DataFrame, size: int, content: str = "content", with_payload: bool = True) -> DataFrame:
    """Fixed-size chunks of every object, a row a chunk, without any shuffle. Empty content gives none."""
    n = F.octet_length(content)
    rest = [c for c in objects.columns if c != content]
    cut = objects.where(n > 0).select(*rest, F.col(content).alias("__c"), n.cast("long").alias("__n"), F.posexplode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1, F.lit(size).cast("long"))).alias("seq", "offset"))
    payload = F.substring(F.col("__c"), F.col("offset").cast("int") + 1, F.lit(size))
    cut = cut.select(*rest, "seq", "offset", F.least(F.lit(size).cast("long"), F.col("__n") - F.col("offset")).alias("length"), payload.alias("payload"))
    out = cut.withColumn("chunk_id", chunk_id("payload"))
    return out if with_payload else out.drop("payload")


def addressed(objects: DataFrame, content: str = "content") -> DataFrame:
    """Objects with blob_id and size."""
    return objects.withColumns({"blob_id": blob_id(content), "size": F.octet_length(content).cast("long")})


def chunk_store(chunks: DataFrame, keys: Sequence[str] = ("ns", "chunk_id")) -> DataFrame:
    """One stored copy a namespace and chunk id, with its CRC-32.

    Ids are reduced first and map-side; the payload is taken by any value, as equal ids hold
    equal bytes.
    """
    return chunks.groupBy(*keys).agg(F.first("length").alias("length"), F.first("payload").alias("payload")).withColumn("crc32", F.crc32("payload"))


def new_chunks(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("ns", "chunk_id")) -> DataFrame:
    """Incoming chunks that the store doesn't hold, each once. Only ids are compared."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def reused_chunks(incoming: DataFrame, stored: DataFrame, keys: Sequence[str] = ("ns", "chunk_id")) -> DataFrame:
    return incoming.join(stored.select(*keys), list(keys), "left_semi")


def manifests(chunks: DataFrame, keys: Sequence[str] = ("ns", "blob_id")) -> DataFrame:
    """One row an object: total size and its ordered chunk list (ids and offsets, no payload).

    A list is as long as one object's chunk count; it never gathers several objects.
    """
    entry = F.struct(F.col("seq").cast("int").alias("seq"), "chunk_id", "offset", "length")
    return chunks.groupBy(*keys).agg(F.sum("length").alias("total_size"), F.array_sort(F.collect_set(entry)).alias("chunks"))


def resolve(manifest: DataFrame, stored: DataFrame, strict: bool = True) -> DataFrame:
    """Ordered chunk rows of manifests. A missing chunk raises, or keeps a null payload where not ``strict``."""
    rest = [c for c in manifest.columns if c != "chunks"]
    wanted = manifest.select(*rest, F.explode("chunks").alias("c")).select(*rest, "c.*")
    got = wanted.join(stored.select("ns", "chunk_id", "payload", "crc32", F.lit(True).alias("__found")), ["ns", "chunk_id"], "left")
    if strict:
        got = got.withColumn("payload", F.when(F.col("__found"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("chunk not found: "), F.col("chunk_id"))).cast("binary")))
    return got.drop("__found")


def reassemble(resolved: DataFrame, keys: Sequence[str] = ("ns", "blob_id")) -> DataFrame:
    """Whole contents from resolved chunks, joined in sequence order inside the JVM."""
    return resolved.groupBy(*keys).agg(F.expr("listagg(payload) WITHIN GROUP (ORDER BY seq)").alias("content"), F.sum("length").alias("size"))


def with_offsets(chunks: DataFrame, keys: Sequence[str] = ("ns", "blob_id")) -> DataFrame:
    """Chunks with offset computed as the running sum of lengths (for lists that lack it)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("offset", F.sum("length").over(w) - F.col("length"))


def read_ranges(chunks: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes of several ranges of several objects.

    ``chunks`` has keys, seq, offset, length, payload; ``ranges`` has keys, start and stop (half
    open; beyond the end reads to the end). Only chunks that overlap are touched and each is cut
    before the join back, so a range costs its own bytes. A range without bytes gives no row.
    """
    hit = chunks.join(ranges, list(keys)).where((F.col("offset") < F.col("stop")) & (F.col("offset") + F.col("length") > F.col("start")))
    return cut_ranges(hit, keys)


def cut_ranges(hit: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bytes of ranges from the chunks that overlap them (keys, start, stop, seq, offset, length, payload)."""
    first = F.greatest(F.col("start") - F.col("offset"), F.lit(0).cast("long"))
    last = F.least(F.col("stop") - F.col("offset"), F.col("length"))
    part = F.col("payload").substr((first + 1).cast("int"), (last - first).cast("int"))
    return hit.select(*keys, "start", "stop", "seq", part.alias("part")).groupBy(*keys, "start", "stop").agg(F.expr("listagg(part) WITHIN GROUP (ORDER BY seq)").alias("bytes"))


def locate(chunks: DataFrame, offset: Column | int, keys: Sequence[str]) -> DataFrame:
    """The chunk that holds an offset, and the position inside it."""
    o = F.lit(offset).cast("long") if isinstance(offset, int) else offset
    return chunks.where((F.col("offset") <= o) & (o < F.col("offset") + F.col("length"))).select(*keys, o.alias("probe"), "seq", (o - F.col("offset")).alias("inner"))


def shared_chunks(chunks: DataFrame, left: Column, right: Column) -> DataFrame:
    """Chunk ids that two selections of objects have in common."""
    return chunks.where(left).select("chunk_id").intersect(chunks.where(right).select("chunk_id"))
