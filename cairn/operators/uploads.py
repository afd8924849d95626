"""Resumable uploads: received ranges, block progress, completion, reassembly and expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(parts: DataFrame, keys: Sequence[str] = ("session",), start: str = "start", stop: str = "stop") -> DataFrame:
    """Disjoint, sorted union of half-open ranges: overlapping and touching ones become one.

    A running maximum of the ends before a row tells whether it opens a new island. Invalid ranges
    (negative start, or not before its end) are ignored, as are repeated parts, which are dropped
    map-side before the window sorts.
    """
    good = parts.where((F.col(start) >= 0) & (F.col(stop) > F.col(start))).select(*keys, F.col(start).alias("start"), F.col(stop).alias("stop"))
    good = good.groupBy(*keys, "start").agg(F.max("stop").alias("stop"))
    order = Window.partitionBy(*keys).orderBy("start")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = good.withColumn("__new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    islands = opened.withColumn("__i", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__i").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__i")


def range_sets(merged: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The ranges of each session as one sorted array."""
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def total_bytes(ranges: Column | str) -> Column:
    r = F.col(ranges) if isinstance(ranges, str) else ranges
    return F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def contains(ranges: Column | str, start: Column | int, stop: Column | int) -> Column:
    r = F.col(ranges) if isinstance(ranges, str) else ranges
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.exists(r, lambda x: (x["start"] <= low) & (x["stop"] >= high))


def is_complete(ranges: Column | str, size: Column | int) -> Column:
    """Exactly one range [0, size), or none for size 0."""
    r = F.col(ranges) if isinstance(ranges, str) else ranges
    n = F.lit(size) if isinstance(size, int) else size
    one = (F.size(r) == 1) & (F.try_element_at(r, F.lit(1))["start"] == 0) & (F.try_element_at(r, F.lit(1))["stop"] == n)
    return F.coalesce(F.when(n == 0, F.size(r) == 0).otherwise(one), F.lit(False))


def received_bytes(merged: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    return merged.groupBy(*keys).agg(F.sum(F.col("stop") - F.col("start")).alias("received"))


def blocks_covered(merged: DataFrame, block: int, size: Column | int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Indexes of the blocks that merged ranges cover wholly; the last block may be short."""
    n = F.lit(size).cast("long") if isinstance(size, int) else size.cast("long")
    first = F.ceil(F.col("start") / block).cast("long")
    last = F.when(F.col("stop") >= n, F.ceil(n / block)).otherwise(F.floor(F.col("stop") / block)).cast("long")
    return merged.where(first < last).select(*keys, F.explode(F.sequence(first, last - 1)).alias("block"))


def block_progress(blocks: DataFrame, block: int, size: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Distinct blocks and bytes by bitmap; the short last block counts by its own length.

    Blocks outside 0 .. ceil(size / block) are ignored, repeated ones count once. Bitmaps of
    32,768 bits are OR-ed map-side, so a session with many parts moves few bytes.
    """
    n = -(-size // block)
    tail = n * block - size
    inside = blocks.where((F.col("block") >= 0) & (F.col("block") < n))
    pieces = inside.groupBy(*keys, F.bitmap_bucket_number("block").alias("__b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("block"))).alias("c"), F.max("block").alias("top"))
    out = pieces.groupBy(*keys).agg(F.sum("c").alias("blocks"), F.max("top").alias("__top"))
    return out.select(*keys, "blocks", (F.col("blocks") * block - F.when(F.col("__top") == n - 1, tail).otherwise(0)).alias("received"), (F.col("blocks") == n).alias("complete"))


def block_ranges(blocks: DataFrame, block: int, size: int, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Islands of received blocks as byte ranges; the last one ends at the size."""
    n = -(-size // block)
    inside = blocks.where((F.col("block") >= 0) & (F.col("block") < n)).select(*keys, "block").distinct()
    island = F.col("block") - F.row_number().over(Window.partitionBy(*keys).orderBy("block"))
    return inside.withColumn("__i", island).groupBy(*keys, "__i").agg((F.min("block") * block).alias("start"), F.least((F.max("block") + 1) * block, F.lit(size)).alias("stop")).drop("__i")


def valid_block_part(offset: Column, length: Column, block: Column | int, size: Column | int) -> Column:
    """An aligned part: starts on a block and fills whole blocks, or ends exactly at the size."""
    b, n = (F.lit(x) if isinstance(x, int) else x for x in (block, size))
    return (offset >= 0) & (length > 0) & (offset % b == 0) & (offset + length <= n) & ((length % b == 0) | (offset + length == n))


def first_arrivals(parts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of retried parts the first to arrive."""
    rest = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def accept_parts(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Parts with a reason (null: accepted), checked before anything is stored.

    ``parts``: session, arrival, offset, data, sha256; ``sessions``: session, expected_size, block_size
    (null or 0: any offset). Unknown sessions, parts beyond the size, unaligned parts and wrong
    checksums are refused.
    """
    got = parts.join(sessions.select("session", "expected_size", "block_size", F.lit(True).alias("__known")), "session", "left")
    length = F.octet_length("data").cast("long")
    beyond = (F.col("expected_size") > 0) & (F.col("offset") + length > F.col("expected_size"))
    unaligned = (F.coalesce("block_size", F.lit(0)) > 0) & ~valid_block_part(F.col("offset"), length, F.nullif(F.col("block_size"), F.lit(0)), F.col("expected_size"))
    wrong = F.coalesce(F.nullif(F.lower("sha256"), F.lit("")) != F.sha2("data", 256), F.lit(False))
    reason = F.when(F.col("__known").isNull(), "unknown session").when((F.col("offset") < 0) | beyond, "out of bounds").when(unaligned, "unaligned").when(wrong, "checksum mismatch")
    return got.withColumn("reason", reason).drop("__known", "expected_size", "block_size")


def assemble(parts: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Contents of sessions from accepted parts; where parts overlap the later arrival wins.

    Parts are cut at all part boundaries of their session, the newest cut of each stretch is kept
    and the stretches are joined in order. Bytes move once however often they were sent again.
    """
    size = F.octet_length("data").cast("long")
    ends = parts.select(*keys, F.explode(F.array(F.col("offset"), F.col("offset") + size)).alias("at")).groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("__cuts"))
    inner = F.filter(F.col("__cuts"), lambda c: (c >= F.col("offset")) & (c < F.col("offset") + size))
    cut = parts.join(ends, list(keys)).select(*keys, "arrival", "offset", "data", "__cuts", F.explode(inner).alias("start"))
    after = F.element_at(F.filter(F.col("__cuts"), lambda c: c > F.col("start")), 1)
    piece = F.col("data").substr((F.col("start") - F.col("offset") + 1).cast("int"), (after - F.col("start")).cast("int"))
    newest = cut.groupBy(*keys, "start").agg(F.max_by(piece, "arrival").alias("piece"))
    return newest.groupBy(*keys).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY start)").alias("content"))


def verify_pieces(content: DataFrame, sessions: DataFrame) -> DataFrame:
    """Blocks whose hash differs from the session's list: session, block."""
    got = content.join(sessions.where(F.size("piece_hashes") > 0).select("session", "block_size", "piece_hashes"), "session")
    each = got.select("session", "content", "block_size", F.posexplode("piece_hashes").alias("block", "expected"))
    own = F.sha2(F.col("content").substr((F.col("block") * F.col("block_size") + 1).cast("int"), F.col("block_size").cast("int")), 256)
    return each.where(own != F.lower("expected")).select("session", "block")


def completion(parts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every session with its state: missing bytes, a wrong piece or file hash, or complete with its content."""
    stop = F.col("offset") + F.octet_length("data")
    have = range_sets(merge_ranges(parts.select("session", F.col("offset").alias("start"), stop.cast("long").alias("stop"))))
    content = assemble(parts)
    bad = verify_pieces(content, sessions).select("session").distinct().withColumn("__bad", F.lit(True))
    out = sessions.join(have, "session", "left").join(content, "session", "left").join(bad, "session", "left")
    ranges = F.coalesce("ranges", F.expr("array()").cast("array<struct<start:bigint,stop:bigint>>"))
    whole = F.coalesce(F.nullif(F.lower("expected_sha256"), F.lit("")) == F.sha2(F.coalesce("content", F.lit(b"")), 256), F.lit(True))
    state = F.when(~is_complete(ranges, F.col("expected_size")), "incomplete").when(F.col("__bad"), "piece mismatch").when(~whole, "checksum mismatch").otherwise("complete")
    return out.select("session", state.alias("state"), total_bytes(ranges).alias("received"), F.when(state == "complete", F.coalesce("content", F.lit(b""))).alias("content"))


def idle(activity: DataFrame, cutoff: Column, keys: Sequence[str] = ("session",), at: str = "ts") -> DataFrame:
    """Sessions whose last activity is before the cutoff."""
    return activity.groupBy(*keys).agg(F.max(at).alias("last_activity")).where(F.col("last_activity") < cutoff)
