"""Integrity, garbage collection, rebuild, compaction and the format upgrade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 0.30


def reachable(refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """(ns, chunk_id) of all chunks that a live reference needs, each once."""
    live = manifest.join(refs.select("ns", "blob_id").distinct(), ["ns", "blob_id"], "left_semi")
    return live.select("ns", F.explode("chunks.chunk_id").alias("chunk_id")).distinct()


def live_chunks(stored: DataFrame, refs: DataFrame, manifest: DataFrame) -> DataFrame:
    return stored.join(reachable(refs, manifest), ["ns", "chunk_id"], "left_semi")


def dead_chunks(stored: DataFrame, refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks with reference count 0; only ids are shuffled against each other."""
    return stored.join(reachable(refs, manifest), ["ns", "chunk_id"], "left_anti")


def dead_manifests(manifest: DataFrame, refs: DataFrame) -> DataFrame:
    return manifest.join(refs.select("ns", "blob_id").distinct(), ["ns", "blob_id"], "left_anti")


def verify(refs: DataFrame, manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """All violations (ns, key, seq, chunk_id, reason): missing manifest or chunk, CRC or hash mismatch.

    Every stored chunk is hashed once, whatever the number of references; only bad ones are
    joined back to keys. An object without bytes (where ``refs`` has the size) or content (null
    id) has no chunk, and so no manifest that could be missing.
    """
    some = refs.where(F.col("blob_id").isNotNull())
    if "size" in refs.columns:
        some = some.where(F.coalesce("size", F.lit(-1)) != 0)
    lost = some.join(manifest.select("ns", "blob_id"), ["ns", "blob_id"], "left_anti").select("ns", "key", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("chunk_id"), F.lit("manifest missing").alias("reason"))
    wanted = reachable(refs, manifest)
    crc = F.crc32("payload") != F.col("crc32")
    sha = F.concat(F.lit("sha256:"), F.sha2("payload", 256)) != F.col("chunk_id")
    state = F.when(F.col("crc32").isNull(), "chunk missing").when(crc, "crc mismatch").when(sha, "hash mismatch")
    checked = stored.select("ns", "chunk_id", "crc32", state.alias("__bad"))
    bad = wanted.join(checked, ["ns", "chunk_id"], "left").select("ns", "chunk_id", F.when(F.col("crc32").isNull(), "chunk missing").otherwise(F.col("__bad")).alias("reason")).where("reason is not null")
    uses = manifest.select("ns", "blob_id", F.explode("chunks").alias("c")).select("ns", "blob_id", "c.seq", "c.chunk_id").join(bad, ["ns", "chunk_id"])
    return lost.unionByName(refs.select("ns", "key", "blob_id").join(uses, ["ns", "blob_id"]).select("ns", "key", "seq", "chunk_id", "reason"))


def rebuild_manifests(pages: DataFrame, keys: Sequence[str] = ("ns", "blob_id")) -> DataFrame:
    """Manifests of the objects whose chunks were all found by a physical scan.

    ``pages`` has keys, seq, total_chunks, chunk_id and length; repeated physical copies count once.
    """
    once = pages.dropDuplicates([*keys, "seq"])
    found = once.groupBy(*keys).agg(F.count("*").alias("found"), F.max("total_chunks").alias("total"), F.sum("length").alias("total_size"), F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "length"))).alias("chunks"))
    return found.where("found = total")


def compaction_candidates(segments: DataFrame, threshold: float | None = None, active: str | None = None) -> DataFrame:
    """Sealed segments whose dead ratio reaches the threshold (None: 0.30)."""
    out = segments.where(F.col("dead_ratio") >= (DEFAULT_THRESHOLD if threshold is None else threshold))
    return out if active is None else out.where(~F.col(active))


def first_copies(pages: DataFrame) -> DataFrame:
    """Merge the consecutive pages of one chunk, then keep the first live copy of every chunk.

    ``pages``: ns, segment, page_offset, chunk_id, total_chunks (0 on continuation pages), length, deleted.
    """
    run = F.sum(F.when(F.col("total_chunks") > 0, 1).otherwise(0)).over(Window.partitionBy("ns", "segment").orderBy("page_offset"))
    whole = pages.withColumn("__run", run).groupBy("ns", "segment", "__run").agg(F.min_by("chunk_id", "page_offset").alias("chunk_id"), F.min("page_offset").alias("page_offset"), F.count("*").alias("page_count"), F.sum("length").alias("length"), F.min_by("deleted", "page_offset").alias("deleted"))
    live = whole.where(~F.col("deleted"))
    return live.groupBy("ns", "chunk_id").agg(F.min_by(F.struct("segment", "page_offset", "page_count", "length"), F.struct("segment", "page_offset")).alias("c")).select("ns", "chunk_id", "c.*")


def upgrade_counts(refs: DataFrame, legacy_manifests: DataFrame) -> DataFrame:
    """Exact per-namespace reference counts of every chunk, from the references alone."""
    per_blob = refs.groupBy("ns", "blob_id").agg(F.count("*").alias("refs"))
    return per_blob.join(legacy_manifests, "blob_id").select("ns", "refs", F.explode("chunk_ids").alias("chunk_id")).groupBy("ns", "chunk_id").agg(F.sum("refs").alias("ref_count"))


def upgrade_chunks(counts: DataFrame, legacy_chunks: DataFrame, scanned: DataFrame) -> DataFrame:
    """A namespace's chunk records after the upgrade.

    The global record is used where it belongs to the namespace; one that another namespace has
    overwritten is repaired from the page found on the namespace's own segments. recovered tells
    which; a row without either is unrecoverable (null length).
    """
    own = legacy_chunks.select("ns", "chunk_id", F.col("length").alias("__own"))
    page = scanned.select("ns", "chunk_id", F.col("length").alias("__page"))
    out = counts.join(own, ["ns", "chunk_id"], "left").join(page, ["ns", "chunk_id"], "left")
    return out.select("ns", "chunk_id", "ref_count", F.coalesce("__own", "__page").alias("length"), F.when(F.col("__own").isNotNull(), "record").when(F.col("__page").isNotNull(), "page").otherwise("lost").alias("recovered"))


def orphans(legacy_manifests: DataFrame, refs: DataFrame, owners: DataFrame, legacy_chunks: DataFrame) -> DataFrame:
    """Legacy objects that nothing references and whose first chunk belongs to a known namespace."""
    loose = legacy_manifests.join(refs.select("blob_id").distinct(), "blob_id", "left_anti").withColumn("chunk_id", F.try_element_at("chunk_ids", F.lit(1)))
    return loose.join(legacy_chunks.select("chunk_id", "ns").distinct(), "chunk_id").join(owners.select("ns"), "ns", "left_semi").select("ns", "blob_id", "chunk_id")


def unregistered(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects that a write-ahead log finished and no manifest knows, with their chunk lists.

    Registering them again changes nothing, so the log may be replayed at every start.
    """
    lists = entries.groupBy("blob_id", "segment", "entry").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "length"))).alias("chunks"), F.sum("length").alias("total_size"))
    return lists.dropDuplicates(["blob_id"]).join(manifest.select("blob_id"), "blob_id", "left_anti").select("blob_id", "total_size", "chunks")
