"""References, listing and the operation log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def point_get(refs: DataFrame, ns: str, key: str) -> DataFrame:
    return refs.where((F.col("ns") == ns) & (F.col("key") == key)).limit(1)


def multi_get(refs: DataFrame, keys: DataFrame, on: Sequence[str] = ("ns", "key")) -> DataFrame:
    """A row for each requested position (``pos``), with nulls where the key is absent."""
    return keys.join(refs, list(on), "left").orderBy("pos")


def list_keys(refs: DataFrame, *, prefix: str = "", after: str | None = None, limit: int = 0, ns: str | None = None) -> DataFrame:
    """References in byte order of the key; ``after`` is exclusive, limit 0 is all.

    Prefix and cursor are pushed to the scan; order and limit together plan as a top-n.
    """
    out = refs if ns is None else refs.where(F.col("ns") == ns)
    if prefix:
        out = out.where(F.startswith(F.col("key"), F.lit(prefix)))
    if after:
        out = out.where(F.col("key") > after)
    out = out.orderBy("key") if ns is not None or "ns" not in refs.columns else out.orderBy("ns", "key")
    return out.limit(limit) if limit else out


def latest(log: DataFrame, keys: Sequence[str], version: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest row of each key, by ``max_by`` (combined map-side, so a hot key is no bottleneck)."""
    order = F.struct(*version)
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, "__r.*")


def live_refs(log: DataFrame, keys: Sequence[str] = ("ns", "key"), version: Sequence[str] = ("ts", "version"), columns: Sequence[str] = ("op", "version", "size")) -> DataFrame:
    """Current references after puts and deletes (updates don't count as versions of content)."""
    base = log.where(F.col("op").isin("put", "delete"))
    return latest(base, keys, version, columns).where("op = 'put'")


def superseded(log: DataFrame, keys: Sequence[str] = ("ns", "key"), version: Sequence[str] = ("ts", "version")) -> DataFrame:
    """Puts that a later put or delete of the same key has replaced."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(v).desc() for v in version])
    base = log.where(F.col("op").isin("put", "delete"))
    return base.withColumn("__r", F.row_number().over(w)).where("op = 'put' and __r > 1").drop("__r")


def current_custom(log: DataFrame, custom: Column, keys: Sequence[str] = ("ns", "key"), version: Sequence[str] = ("ts", "version")) -> DataFrame:
    """The custom value of each live key: that of the last update after its last put, or the put's own.

    An update replaces the whole value; one on an absent key does nothing.
    """
    at = F.struct(*version)
    rows = log.select(*keys, "op", at.alias("__at"), custom.alias("__custom"))
    base = F.col("op").isin("put", "delete")
    last = rows.groupBy(*keys).agg(F.max(F.when(base, F.col("__at"))).alias("__base"), F.max_by("op", F.when(base, F.col("__at"))).alias("__op"))
    live = last.where("__op = 'put'").select(*keys, "__base")
    newer = rows.join(live, list(keys)).where((F.col("__at") == F.col("__base")) | (F.col("op") == "update") & (F.col("__at") > F.col("__base")))
    return newer.groupBy(*keys).agg(F.max_by("__custom", "__at").alias("custom"))


def rename(refs: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply (ns, key, new_key) in order of the old key; returns the references and the rejected rows.

    A rename is rejected where the old key is absent, the target exists, equals the old key, or an
    earlier rename of the same batch has taken it. All other columns stay, timestamps included.
    """
    known = renames.join(refs.select("ns", "key"), ["ns", "key"], "left_semi")
    absent = renames.join(refs.select("ns", "key"), ["ns", "key"], "left_anti").withColumn("reason", F.lit("not found"))
    taken = known.join(refs.select("ns", F.col("key").alias("new_key")), ["ns", "new_key"], "left_semi").withColumn("reason", F.lit("already exists"))
    free = known.join(refs.select("ns", F.col("key").alias("new_key")), ["ns", "new_key"], "left_anti")
    first = free.groupBy("ns", "new_key").agg(F.min("key").alias("key"))
    late = free.join(first, ["ns", "new_key", "key"], "left_anti").withColumn("reason", F.lit("already exists"))
    moved = refs.join(first, ["ns", "key"], "left").withColumn("key", F.coalesce("new_key", "key")).select(*refs.columns)
    order = ["ns", "key", "new_key", "reason"]
    return moved, absent.select(order).unionByName(taken.select(order)).unionByName(late.select(order))


def delete(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """References without the given (ns, key); absent and repeated keys do no harm."""
    return refs.join(keys.select("ns", "key"), ["ns", "key"], "left_anti")


def conditional(refs: DataFrame, requests: DataFrame) -> DataFrame:
    """What a web server would answer to requests for objects, bytes aside.

    ``requests``: key and, where present, if_match, if_none_match, if_range (texts of entity tags, or
    for if_range a date), if_modified_since, if_unmodified_since (timestamps) and range_header
    ("bytes=0-9,-5"). ``refs``: key, blob_id, size, updated_at, content_type. An object's tag is its
    quoted content address. Returns the request's columns with status (200, 206, 304, 404, 412 or
    416), etag, last_modified (whole seconds), content_type, size and ranges (sorted as asked, half
    open, cut to the size; null unless 206). Malformed ranges are ignored, as the protocol wants.
    """
    names = {"if_match": "string", "if_none_match": "string", "if_range": "string", "range_header": "string", "if_modified_since": "timestamp", "if_unmodified_since": "timestamp"}
    asked = requests.select("key", *[(F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names.items()])
    got = asked.join(refs.select("key", "blob_id", "size", "content_type", F.date_trunc("second", "updated_at").alias("last_modified")), "key", "left")
    tag = F.concat(F.lit('"'), "blob_id", F.lit('"'))

    def named(header: str, weak: bool) -> Column:
        tags = F.transform(F.split(F.col(header), ","), lambda t: F.regexp_replace(F.trim(t), "^W/", "") if weak else F.trim(t))
        return (F.trim(header) == "*") | F.array_contains(tags, tag)

    failed = F.when(F.col("if_match").isNotNull(), ~named("if_match", False)).otherwise(F.coalesce(F.col("last_modified") > F.col("if_unmodified_since"), F.lit(False)))
    same = F.when(F.col("if_none_match").isNotNull(), named("if_none_match", True)).otherwise(F.coalesce(F.col("last_modified") <= F.col("if_modified_since"), F.lit(False)))
    applies = F.col("if_range").isNull() | (F.trim("if_range") == tag) | F.coalesce(F.try_to_timestamp("if_range") == F.col("last_modified"), F.lit(False))
    well = F.col("range_header").rlike(r"^bytes=\s*(\d{1,18}-\d{0,18}|-\d{1,18})(\s*,\s*(\d{1,18}-\d{0,18}|-\d{1,18}))*\s*$")

    def span(part: Column) -> Column:
        first, last = F.trim(F.split(part, "-")[0]).try_cast("long"), F.trim(F.get(F.split(part, "-"), F.lit(1))).try_cast("long")
        start = F.when(first.isNull(), F.greatest(F.col("size") - last, F.lit(0).cast("long"))).otherwise(first)
        stop = F.when(first.isNull() | last.isNull(), F.col("size")).otherwise(F.least(last + 1, F.col("size")))
        return F.struct(start.alias("start"), stop.alias("stop"))

    spans = F.transform(F.split(F.regexp_replace("range_header", "^bytes=", ""), ","), span)
    backward = F.exists(F.split(F.regexp_replace("range_header", "^bytes=", ""), ","), lambda p: F.coalesce(F.trim(F.split(p, "-")[0]).try_cast("long") > F.trim(F.get(F.split(p, "-"), F.lit(1))).try_cast("long"), F.lit(False)))
    inside = F.filter(spans, lambda r: r["start"] < r["stop"])
    partial = F.coalesce(well & ~backward & applies, F.lit(False))
    status = F.when(F.col("blob_id").isNull(), 404).when(failed, 412).when(same, 304).when(partial & (F.size(inside) == 0), 416).when(partial, 206).otherwise(200)
    out = got.withColumn("status", status)
    return out.select("key", *[c for c in names if c in requests.columns], "status", tag.alias("etag"), "last_modified", "content_type", "size", F.when(F.col("status") == 206, inside).alias("ranges"))
