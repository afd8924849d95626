"""Usage statistics and reference counts, always derived and never stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long(c) -> F.Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def namespace_stats(refs: DataFrame, chunks: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """blob_count, bytes_stored and chunk_count (logical) over references; bytes_physical and
    distinct_chunk_count over distinct chunks. A namespace of ``namespaces`` without references
    gets a row of zeros."""
    logical = refs.groupBy("ns").agg(F.count("*").alias("blob_count"), F.sum("size").alias("bytes_stored"), F.sum("chunk_count").alias("chunk_count"))
    distinct = chunks.groupBy("ns", "chunk_id").agg(F.first("length").alias("length")).groupBy("ns").agg(F.sum("length").alias("bytes_physical"), F.count("*").alias("distinct_chunk_count"))
    out = logical.join(distinct, "ns", "full")
    if namespaces is not None:
        out = namespaces.select("ns").distinct().join(out, "ns", "left")
    names = ["blob_count", "bytes_stored", "chunk_count", "bytes_physical", "distinct_chunk_count"]
    return out.select("ns", *[_long(F.col(c)).alias(c) for c in names])


def store_stats(per_namespace: DataFrame) -> DataFrame:
    """One row over all namespaces; the ratio of stored to physical bytes is 0 where nothing is stored."""
    total = per_namespace.agg(F.count("*").alias("namespace_count"), *[_long(F.sum(c)).alias(f"total_{c}") for c in ("blob_count", "bytes_stored", "bytes_physical")])
    return total.withColumn("deduplication_ratio", F.when(F.col("total_bytes_physical") == 0, F.lit(0.0)).otherwise(F.col("total_bytes_stored") / F.col("total_bytes_physical")))


def rollup(refs: DataFrame) -> DataFrame:
    """Detail rows and the total (null ns) in one pass."""
    return refs.rollup("ns").agg(F.count("*").alias("blob_count"), _long(F.sum("size")).alias("bytes_stored"))


def blob_refcounts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("ns", "blob_id").agg(F.count("*").alias("ref_count"), F.min("key").alias("first_key"))


def chunk_refcounts(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """References times occurrences of every chunk. Counts are taken per object before its list is exploded."""
    counts = blob_refcounts(refs).select("ns", "blob_id", "ref_count")
    return manifest.join(counts, ["ns", "blob_id"]).select("ns", "ref_count", F.explode("chunks").alias("c")).groupBy("ns", F.col("c.chunk_id").alias("chunk_id")).agg(F.sum("ref_count").alias("ref_count"))


def segment_stats(chunks: DataFrame, segment: str = "segment", dead: str = "dead") -> DataFrame:
    """Chunks and bytes, total and dead, of every segment, with the dead ratio (0 where empty)."""
    gone = F.col(dead)
    out = chunks.groupBy(segment).agg(
        F.count("*").alias("chunks_total"),
        F.count(F.when(gone, True)).alias("chunks_dead"),
        _long(F.sum("length")).alias("bytes_total"),
        _long(F.sum(F.when(gone, F.col("length")))).alias("bytes_dead"),
    )
    return out.withColumn("dead_ratio", F.coalesce(F.try_divide("bytes_dead", "bytes_total"), F.lit(0.0)))


def duplicate_objects(refs: DataFrame) -> DataFrame:
    return refs.groupBy("ns", "blob_id").agg(F.count("*").alias("copies"), F.min("key").alias("first_key"), F.min("size").alias("size")).where("copies > 1")
