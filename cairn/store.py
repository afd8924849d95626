"""The object store: namespaces of keyed, deduplicated, optionally sealed objects.

Batch first: ``put_many`` takes a DataFrame, and everything in it is one plan and one commit.
Reference counts and statistics are derived from the tables, never stored.
"""

from __future__ import annotations

import re
import secrets
import threading
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

from .commits import RETENTION, CommitLog, Version, partition_of
from .errors import AlreadyExists, Closed, Conflict, Corruption, EmptyObject, InvalidKey, InvalidNamespace, NotFound, QuotaExceeded, UnsupportedFormat
from .functions import blob_id, content_type, generate_key, hidden_key, open_sealed, seal, unwrap_key, wrap_key
from .operators import cdc, chunks, maintenance, quota, references, stats


def _schema(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _L, _I, _B, _T = StringType(), LongType(), IntegerType(), BinaryType(), TimestampType()
_ENTRY = _schema(seq=_I, chunk_id=_S, offset=_L, length=_L)
REFS = _schema(ns_uid=_S, key=_S, version=_L, op=_S, blob_id=_S, content_type=_S, size=_L, chunk_count=_L, created_at=_T, updated_at=_T, custom=MapType(_S, _S))
MANIFESTS = _schema(ns_uid=_S, blob_id=_S, total_size=_L, created_at=_T, chunks=ArrayType(_ENTRY))
CHUNKS = _schema(ns_uid=_S, chunk_id=_S, length=_L, crc32=_L, nonce=_B, tag=_B, payload=_B)
INCOMING = _schema(ns_uid=_S, key=_S, content_type=_S, custom=MapType(_S, _S), blob_id=_S, size=_L, seq=_I, offset=_L, length=_L, chunk_id=_S, nonce=_B, tag=_B, payload=_B)
SCHEMAS = {"refs": REFS, "manifests": MANIFESTS, "chunks": CHUNKS}
FORMAT = 2
#: Chunk files are sorted by id and carry Bloom filters of it, so reading by id skips most row groups.
_BY_ID = {"parquet.bloom.filter.enabled#chunk_id": "true", "parquet.bloom.filter.expected.ndv#chunk_id": "100000"}
#: So many chunk ids become a pushed filter; more are joined.
_PUSHED = 500


class KeyProvider(Protocol):
    """Master keys by version; the current one wraps new data keys."""

    def current(self) -> tuple[str, bytes]: ...

    def key(self, version: str) -> bytes: ...


@dataclass(frozen=True)
class Quota:
    """Limits of a namespace; 0 is unlimited."""

    max_bytes: int = 0
    max_blob_count: int = 0
    max_blob_size: int = 0


@dataclass(frozen=True)
class Options:
    """``chunk_size`` is the average for content-defined chunks and exact for fixed ones.

    A chunk file holds at most about ``segment_size`` bytes of average chunks; compaction joins
    folders below ``merge_below`` bytes. ``retention`` is in seconds (see ``cairn.commits``).
    """

    chunk_size: int = 256 * 1024
    fixed: bool = False
    page_size: int = 16384
    segment_size: int = 1 << 30
    rewrite_threshold: float | None = None
    merge_below: int = 32 << 20
    retention: float = RETENTION
    retries: int = 5

    def __post_init__(self) -> None:
        if self.chunk_size < 4 or self.page_size <= chunks.HEADER or self.page_size >= 1 << 32:
            raise ValueError("chunk_size must be at least 4; page_size must exceed the 88-byte header and fit 32 bits")
        if self.chunk_size > self.segment_size or self.page_size > self.segment_size:
            raise ValueError("neither a chunk nor a page may exceed segment_size")
        if self.merge_below < 0 or self.retention < 0:
            raise ValueError("merge_below and retention must not be negative")
        if self.rewrite_threshold is not None and not 0 <= self.rewrite_threshold <= 1:
            raise ValueError("rewrite_threshold lies between 0 and 1")
        if self.retries < 1:
            raise ValueError("retries must be positive")


def custom_string(value) -> str:
    """A custom value as text: lower-case booleans, floats in the shortest form with an exponent
    below 1e-4 and from 1e6 on, ``<nil>`` for None."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return str(value).lower()
    if not isinstance(value, float):
        return str(value)
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "+Inf" if value > 0 else "-Inf"
    if value == 0:
        return "-0" if str(value)[0] == "-" else "0"
    digits, exponent = f"{value:.17e}".split("e")
    for n in range(17):
        digits, exponent = f"{value:.{n}e}".split("e")
        if float(f"{digits}e{exponent}") == value:
            break
    power = int(exponent)
    if -4 <= power < 6:
        return f"{value:.{max(0, len(digits.lstrip('-').replace('.', '')) - 1 - power)}f}"
    return f"{digits}e{'-' if power < 0 else '+'}{abs(power):02d}"


class ObjectStore:
    """``with ObjectStore(spark, root) as store: ...``

    Opening checks the format marker and finishes erasures that a crash has left; half-done writes
    need no replay, as nothing uncommitted is ever seen. Operations may come from several threads;
    ``close`` refuses new ones and waits for those that run.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, keys: KeyProvider | None = None) -> None:
        self.spark, self.options, self.keys = spark, options or Options(), keys
        self.log = CommitLog(spark, root)
        self._open, self._running, self._gate = True, 0, threading.Condition()
        self._check_format()
        self.recover()

    def __enter__(self) -> "ObjectStore":
        return self

    def __exit__(self, *_) -> None:
        if self._open:
            self.close()

    def close(self, timeout: float | None = None) -> None:
        """Refuse further operations and wait for running ones. Closing twice is an error."""
        with self._gate:
            self._check()
            self._open = False
            if not self._gate.wait_for(lambda: self._running == 0, timeout):
                raise TimeoutError("operations still run")

    def _check(self) -> None:
        if not self._open:
            raise Closed

    @contextmanager
    def _operation(self) -> Iterator[None]:
        with self._gate:
            self._check()
            self._running += 1
        try:
            yield
        finally:
            with self._gate:
                self._running -= 1
                self._gate.notify_all()

    def _check_format(self) -> None:
        """A store carries its format number; one that has another number is refused."""
        found = self.log.head().info.get("format")
        if found is None:
            try:
                head = self.log.head()
                self.log.commit(head, {}, {}, {**head.info, "format": FORMAT})
            except Conflict:
                found = self.log.head().info.get("format")
        if found not in (None, FORMAT):
            raise UnsupportedFormat(found, FORMAT)

    @property
    def format(self) -> int:
        return self.log.head().info["format"]

    def recover(self) -> dict[str, int]:
        """What opening does after a crash: finish pending erasures, remove what is out of retention."""
        return {"namespaces_erased": self.cleanup_deleted(), "folders_removed": self.log.vacuum(self.options.retention)}

    # -- versions ---------------------------------------------------------------------------

    def _change(self, build: Callable[[Version], tuple[dict, dict, dict]]) -> Version:
        """Build a change on the newest version and commit it; on a conflict all over again, staging
        included, as what was built may depend on the version."""
        with self._operation():
            for left in range(self.options.retries, 0, -1):
                base = self.log.head()
                add, replace, info = build(base)
                try:
                    return self.log.commit(base, add, replace, {**base.info, **info})
                except Conflict:
                    if left == 1:
                        raise
        raise AssertionError

    def _stage(self, table: str, df: DataFrame, base: Version) -> list[str]:
        if table == "chunks":
            per_file = max(1, self.options.segment_size // self.options.chunk_size)
            return self.log.stage(table, df.sortWithinPartitions("ns_uid", "chunk_id"), base.number + 1, options={**_BY_ID, "maxRecordsPerFile": str(per_file)})
        return self.log.stage(table, df, base.number + 1)

    def _spaces(self, version: Version) -> dict[str, dict]:
        return version.info.get("namespaces", {})

    def _space(self, version: Version, name: str) -> dict:
        got = self._spaces(version).get(name)
        if got is None:
            raise NotFound("namespace", name)
        return got

    # -- namespaces -------------------------------------------------------------------------

    def create_namespace(self, name: str, *, display_name: str = "", quota: Quota | None = None, custom: dict[str, str] | None = None, encrypted: bool = False, if_not_exists: bool = False, uid: str | None = None) -> "Namespace":
        """A namespace with a fresh random uid; re-creating a deleted name shares nothing with it.

        A given ``uid`` (an import keeps its own) must belong to no live namespace and to none whose
        erasure is pending.
        """
        if uid is not None and not re.fullmatch(r"[a-z0-9_-]{1,64}", uid):
            raise InvalidNamespace(uid)
        if not re.fullmatch(r"[a-z0-9][a-z0-9\-_]{0,61}[a-z0-9]", name):
            raise InvalidNamespace(name)
        sealed = None
        if encrypted:
            if self.keys is None:
                raise ValueError("an encrypted namespace needs a key provider")
            key_version, master = self.keys.current()
            sealed = {"wrapped": wrap_key(self.spark, generate_key(), master).hex(), "key_version": key_version}
        record = {"uid": uid or secrets.token_hex(16), "display_name": display_name, "quota": asdict(quota or Quota()), "custom": custom or {}, "encryption": sealed}

        def build(base: Version):
            if name in self._spaces(base):
                if if_not_exists:
                    raise _Present
                raise AlreadyExists("namespace", name)
            if record["uid"] in {r["uid"] for r in self._spaces(base).values()} | base.info.get("tombstones", {}).keys():
                raise AlreadyExists("namespace uid", record["uid"])
            return {}, {}, {"namespaces": {**self._spaces(base), name: record}}

        try:
            self._change(build)
        except _Present:
            pass
        return self.namespace(name)

    def namespace(self, name: str) -> "Namespace":
        self._check()
        self._space(self.log.head(), name)
        return Namespace(self, name)

    def list_namespaces(self) -> list[str]:
        self._check()
        return sorted(self._spaces(self.log.head()))

    def delete_namespace(self, name: str) -> None:
        """Unlink the name and leave a tombstone in one commit, then erase what it owned."""

        def build(base: Version):
            gone = self._space(base, name)
            spaces = {k: v for k, v in self._spaces(base).items() if k != name}
            return {}, {}, {"namespaces": spaces, "tombstones": {**base.info.get("tombstones", {}), gone["uid"]: name}}

        self._change(build)
        self.cleanup_deleted()

    def cleanup_deleted(self) -> int:
        """Erase what tombstoned namespaces own; may be repeated at any time.

        A change of the folder list alone: no row of another namespace is read. The folders of every
        kept version go from the disk at once, whatever the retention time; the tombstone goes last.
        """
        pending = list(self.log.head().info.get("tombstones", {}))
        if not pending:
            return 0

        def unlink(base: Version):
            return {}, {t: [f for f in base.tables.get(t, ()) if partition_of(f) not in pending] for t in base.tables}, {}

        def forget(base: Version):
            return {}, {}, {"tombstones": {k: v for k, v in base.info.get("tombstones", {}).items() if k not in pending}}

        self._change(unlink)
        self.log.drop(f for f in self.log.listed(self.log.numbers()) if partition_of(f) in pending)
        self._change(forget)
        return len(pending)

    # -- statistics and maintenance over all namespaces ----------------------------------------

    def _named(self, version: Version, table: str) -> DataFrame:
        """A table with ``ns`` (name) for the live namespaces.

        Their names, a row a namespace as in the commit file, go to the rows: nothing tells Spark that
        they are few, and it would shuffle every payload by namespace to join them.
        """
        names = self.spark.createDataFrame([(v["uid"], k) for k, v in self._spaces(version).items()], "ns_uid string, ns string")
        return self.log.table(version, table, SCHEMAS[table]).join(F.broadcast(names), "ns_uid")

    def refs(self, version: Version | None = None) -> DataFrame:
        """Current references of all namespaces."""
        v = version or self.log.head()
        rows = self._named(v, "refs")
        cols = [c for c in REFS.names if c not in ("key", "version", "ns_uid")]
        return references.latest(rows, ["ns", "key"], ["version"], cols).where("op <> 'delete'").drop("op")

    def manifests(self, version: Version | None = None) -> DataFrame:
        return self._named(version or self.log.head(), "manifests").drop("ns_uid")

    def chunk_rows(self, version: Version | None = None) -> DataFrame:
        return self._named(version or self.log.head(), "chunks").drop("ns_uid")

    def stats(self) -> DataFrame:
        """Usage of every namespace; bytes_physical are the stored chunks', dead ones included."""
        self._check()
        v = self.log.head()
        spaces = self.spark.createDataFrame([(k,) for k in self._spaces(v)], "ns string")
        stored = self.chunk_rows(v)
        usage = stats.namespace_stats(self.refs(v), stored, spaces)
        dead = maintenance.dead_chunks(stored.select("ns", "chunk_id", "length"), self.refs(v), self.manifests(v)).groupBy("ns").agg(F.count("*").alias("dead_chunks"), F.sum("length").alias("dead_bytes"))
        zero = F.lit(0).cast("long")
        return usage.join(dead, "ns", "left").withColumns({"dead_chunks": F.coalesce("dead_chunks", zero), "dead_bytes": F.coalesce("dead_bytes", zero)})

    def store_stats(self) -> DataFrame:
        return stats.store_stats(self.stats())

    def verify(self) -> DataFrame:
        """All violations of all namespaces, sealed ones opened with their keys."""
        self._check()
        v = self.log.head()
        return maintenance.verify(self.refs(v), self.manifests(v), self._plain(v))

    def verify_first(self) -> None:
        bad = self.verify().orderBy("ns", "key", "seq").first()
        if bad is not None:
            raise Corruption(f"{bad.reason}: {bad.ns}/{bad.key} chunk {bad.seq}")

    def _plain(self, version: Version) -> DataFrame:
        """Chunks with plain payloads; crc32 (taken over stored bytes) is recomputed where it held."""
        parts = []
        rows = self.chunk_rows(version)
        for name, record in self._spaces(version).items():
            own = rows.where(F.col("ns") == name)
            if record["encryption"]:
                stored_ok = F.crc32("payload") == F.col("crc32")
                plain = open_sealed("nonce", "tag", "payload", self._data_key(record), "chunk_id", strict=False)
                own = own.withColumn("__ok", stored_ok).withColumn("payload", plain).withColumn("crc32", F.when(F.col("__ok"), F.crc32("payload")).otherwise(F.lit(-1))).drop("__ok")
            parts.append(own.select("ns", "chunk_id", "length", "crc32", "payload"))
        out = rows.select("ns", "chunk_id", "length", "crc32", "payload").limit(0) if not parts else parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _data_key(self, record: dict) -> Column:
        if self.keys is None:
            raise ValueError("this namespace is encrypted; a key provider is needed")
        seal_ = record["encryption"]
        return hidden_key(unwrap_key(self.spark, bytes.fromhex(seal_["wrapped"]), self.keys.key(seal_["key_version"])))

    # -- folders --------------------------------------------------------------------------------

    def list_segments(self, table: str = "chunks") -> list[str]:
        """Folders of a table, in order of the version that wrote them."""
        self._check()
        return sorted(self.log.head().tables.get(table, ()))

    def active_segment(self) -> str | None:
        """The chunk folder written last."""
        return max(self.list_segments(), default=None)

    def highest_segment(self) -> int:
        """The highest version number of any batch on the disk, committed or not (0: none)."""
        self._check()
        return max((int(f.partition("batch=")[2][:20]) for f in self.log.batches()), default=0)

    def is_dirty(self) -> bool:
        """Whether the disk holds batches that no version lists: writes under way or left by a crash."""
        self._check()
        listed = {f.rpartition("/")[0] for f in self.log.listed(self.log.numbers())}
        return any(f not in listed for f in self.log.batches())

    def delete_segment(self, folder: str) -> None:
        """Remove one unlisted folder from the disk at once; a live one is refused."""
        with self._operation():
            if folder in self.log.listed([self.log.head().number]):
                raise ValueError(f"{folder} is in use")
            self.log.drop([folder])

    def segment_stats(self) -> DataFrame:
        """Chunks and bytes, total and dead, of every chunk folder, in order."""
        with self._operation():
            v = self.log.head()
            return stats.segment_stats(self._judged(v, self._needed(v))).orderBy("segment")

    def _current(self, version: Version) -> DataFrame:
        cols = [c for c in REFS.names if c not in ("ns_uid", "key")]
        return references.latest(self.log.table(version, "refs", REFS), ["ns_uid", "key"], ["version"], cols).where("op <> 'delete'").select(REFS.names)

    def _needed(self, version: Version) -> DataFrame:
        live = self.log.table(version, "manifests", MANIFESTS).join(self._current(version).select("ns_uid", "blob_id").distinct(), ["ns_uid", "blob_id"], "left_semi")
        return live.select("ns_uid", F.explode("chunks.chunk_id").alias("chunk_id")).distinct()

    def _judged(self, version: Version, needed: DataFrame) -> DataFrame:
        """(segment, length, dead) of every stored chunk; payloads are not read."""
        place = F.regexp_extract(F.col("_metadata.file_path"), r"(data/chunks/batch=[^/]+/[^/]+)/[^/]+$", 1)
        folders = self.log.folders(version, "chunks")
        rows = self.log.scan("chunks", folders, CHUNKS)
        rows = rows.select("ns_uid", "chunk_id", "length", place.alias("segment")) if folders else rows.select("ns_uid", "chunk_id", "length", F.lit("").alias("segment"))
        return rows.join(needed.withColumn("__live", F.lit(True)), ["ns_uid", "chunk_id"], "left").select("segment", "length", F.col("__live").isNull().alias("dead"))

    def compact(self, threshold: float | None = None) -> dict[str, int]:
        """Drop dead chunks and manifests, squash the reference log, join small folders.

        Folders whose dead share of bytes reaches the threshold (None: the option, else 0.30) are
        rewritten, as are those below ``merge_below`` bytes where there are several of one namespace.
        One aggregate finds them all and one job rewrites them. Everything becomes visible in one
        commit; replaced folders stay on the disk for the retention time.
        """
        result = {"chunks_removed": 0, "bytes_reclaimed": 0, "folders_rewritten": 0}
        least = next(x for x in (threshold, self.options.rewrite_threshold, maintenance.DEFAULT_THRESHOLD) if x is not None)

        def build(base: Version):
            needed = self._needed(base)
            found = stats.segment_stats(self._judged(base, needed)).collect()  # a row a folder, as in the commit file
            rewrite = {r.segment for r in found if r.chunks_dead and r.dead_ratio >= least}
            small: dict[str, list[str]] = {}
            for r in found:
                if r.segment not in rewrite and r.bytes_total < self.options.merge_below:
                    small.setdefault(partition_of(r.segment), []).append(r.segment)
            rewrite |= {f for fs in small.values() for f in fs if len(fs) > 1}
            gone = [r for r in found if r.segment in rewrite]
            result.update(chunks_removed=sum(r.chunks_dead for r in gone), bytes_reclaimed=sum(r.bytes_dead for r in gone), folders_rewritten=len(rewrite))
            replace = {"chunks": self.log.folders(base, "chunks")}
            if rewrite:
                rows = self.log.scan("chunks", sorted(rewrite), CHUNKS).join(needed, ["ns_uid", "chunk_id"], "left_semi").select(CHUNKS.names)
                replace["chunks"] = [f for f in replace["chunks"] if f not in rewrite] + self._stage("chunks", rows, base)
            if base.tables.get("refs"):
                current = self._current(base)
                replace["refs"] = self._stage("refs", current, base)
                live = self.log.table(base, "manifests", MANIFESTS).join(current.select("ns_uid", "blob_id").distinct(), ["ns_uid", "blob_id"], "left_semi")
                replace["manifests"] = self._stage("manifests", live.select(MANIFESTS.names), base)
            return {}, replace, {}

        self._change(build)
        self.log.vacuum(self.options.retention)
        return result


class _Present(Exception):
    pass


class Namespace:
    """Handle of one namespace; it stops working when the name is deleted."""

    def __init__(self, store: ObjectStore, name: str) -> None:
        self.store, self.name = store, name
        self.uid = store._space(store.log.head(), name)["uid"]

    def _record(self, version: Version) -> dict:
        self.store._check()
        got = self.store._space(version, self.name)
        if got["uid"] != self.uid:
            raise NotFound("namespace", self.name)
        return got

    def _table(self, version: Version, name: str, schema: StructType) -> DataFrame:
        """The namespace's own rows; other namespaces' folders are not even listed."""
        return self.store.log.table(version, name, schema, self.uid)

    def refs(self, version: Version | None = None) -> DataFrame:
        """Current references: key and metadata, never a payload."""
        v = version or self.store.log.head()
        self._record(v)
        cols = [c for c in REFS.names if c not in ("ns_uid", "key")]
        return references.latest(self._table(v, "refs", REFS), ["key"], ["version"], cols).where("op <> 'delete'").drop("op")

    # -- writing --------------------------------------------------------------------------------

    def put_many(self, objects: DataFrame) -> DataFrame:
        """Store objects (key, content, and optionally content_type and custom); returns their references.

        All or nothing: an empty key or content, a key given twice or a quota overrun rejects the batch
        before anything is visible. ``objects`` is evaluated once: its chunks are staged (sealed, if the
        namespace is), and all else is derived from that table. Ids decide which chunks are new; the
        payload of each moves once.
        """
        s = self.store
        with s._operation():
            record = self._record(s.log.head())
            o = objects
            for c, kind in (("content_type", "string"), ("custom", "map<string,string>")):
                if c not in o.columns:
                    o = o.withColumn(c, F.lit(None).cast(kind))
            seen = Observation()
            size = F.octet_length("content").cast("long")
            o = o.select("key", "content", "content_type", "custom").observe(seen, F.count(F.when(F.col("key").isNull() | (F.col("key") == ""), 1)).alias("keys"), F.count(F.when(size.isNull() | (size == 0), 1)).alias("empty"))
            o = o.select("key", content_type("content", "content_type").alias("content_type"), "custom", blob_id("content").alias("blob_id"), size.alias("size"), "content")
            opt = s.options
            cut = chunks.fixed_chunks(o, opt.chunk_size) if opt.fixed else cdc.content_chunks(o, opt.chunk_size)
            rest = [c for c in INCOMING.names if c not in ("ns_uid", "nonce", "tag", "payload")]
            if record["encryption"]:
                cut = cut.select(*rest, seal("payload", s._data_key(record), "chunk_id").alias("s")).select(*rest, "s.nonce", "s.tag", "s.payload")
            else:
                cut = cut.select(*rest, F.lit(None).cast("binary").alias("nonce"), F.lit(None).cast("binary").alias("tag"), "payload")
            batch = s.log.stage("incoming", cut.withColumn("ns_uid", F.lit(self.uid)).select(INCOMING.names), s.log.head().number + 1)
            try:
                bad = seen.get
                if bad["keys"]:
                    raise InvalidKey("empty")
                if bad["empty"]:
                    raise EmptyObject
                incoming = s.log.scan("incoming", batch, INCOMING)
                heads = incoming.where("seq = 0").select("key", "content_type", "custom", "blob_id", "size")
                if heads.groupBy("key").count().where("count > 1").limit(1).count():
                    raise InvalidKey("given more than once in a batch")
                done = s._change(lambda base: self._put(base, incoming, heads))
            finally:
                s.log.drop({f.rpartition("/")[0] for f in batch})
        return self.refs(done).where(F.col("version") == done.number)

    def _put(self, base: Version, incoming: DataFrame, heads: DataFrame):
        record = self._record(base)
        self._admit(base, record, heads)
        uid, now = F.lit(self.uid).alias("ns_uid"), F.current_timestamp()
        known = self._table(base, "chunks", CHUNKS).select("chunk_id")
        first = incoming.groupBy("chunk_id").agg(F.min_by(F.struct("key", "seq"), F.struct("key", "seq")).alias("at")).join(known, "chunk_id", "left_anti").select("chunk_id", "at.key", "at.seq")
        fresh = incoming.join(first, ["key", "seq", "chunk_id"], "left_semi")
        add = {"chunks": self.store._stage("chunks", fresh.select(uid, "chunk_id", "length", F.crc32("payload").alias("crc32"), "nonce", "tag", "payload"), base)}
        lists = chunks.manifests(incoming.select("blob_id", "seq", "chunk_id", "offset", "length"), ["blob_id"])
        old = self._table(base, "manifests", MANIFESTS).select("blob_id")
        add["manifests"] = self.store._stage("manifests", lists.join(old, "blob_id", "left_anti").withColumns({"ns_uid": uid, "created_at": now}).select(MANIFESTS.names), base)
        counts = incoming.groupBy("key").agg(F.count("*").alias("chunk_count"))
        refs = heads.join(counts, "key").withColumns({"ns_uid": uid, "version": F.lit(base.number + 1).cast("long"), "op": F.lit("put"), "created_at": now, "updated_at": now}).select(REFS.names)
        add["refs"] = self.store._stage("refs", refs, base)
        return add, {}, {}

    def _admit(self, base: Version, record: dict, o: DataFrame) -> None:
        q = record["quota"]
        if not any(q.values()):
            return
        used = self.refs(base).agg(F.count("*").alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        limits = self.store.spark.createDataFrame([(self.name, q["max_blob_count"], q["max_bytes"], q["max_blob_size"], used.c, used.b)], "ns string, max_blob_count long, max_bytes long, max_blob_size long, used_count long, used_bytes long")
        asked = o.select(F.lit(self.name).alias("ns"), "key", "size")
        refused = quota.admit(asked, limits, order="key").where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"), F.min("key").alias("key")).orderBy("key").first()
        if refused is not None:
            raise QuotaExceeded(self.name, refused.reason, refused.n)

    def put(self, key: str, content: bytes, content_type: str | None = None, custom: dict[str, str] | None = None):
        """Store one object; the batch form is the efficient one."""
        if not key:
            raise InvalidKey("empty")
        if not content:
            raise EmptyObject
        row = self.store.spark.createDataFrame([(key, bytearray(content), content_type, custom)], "key string, content binary, content_type string, custom map<string,string>")
        return self.put_many(row).first()

    def _append(self, rows: Callable[[Version], DataFrame]) -> Version:
        def build(base: Version):
            self._record(base)
            made = rows(base).withColumns({"ns_uid": F.lit(self.uid), "version": F.lit(base.number + 1).cast("long")}).select(REFS.names)
            return {"refs": self.store._stage("refs", made, base)}, {}, {}

        return self.store._change(build)

    def delete(self, *keys: str) -> None:
        """Remove references in one commit (an object with what hangs on it); keys that don't exist do no harm."""
        if not all(keys):
            raise InvalidKey("empty")
        self._append(lambda v: self.refs(v).where(F.col("key").isin(*keys)).withColumn("op", F.lit("delete")))

    def delete_many(self, keys: DataFrame) -> None:
        """``delete`` for a table of keys of any size (column key)."""
        self._append(lambda v: self.refs(v).join(keys.select("key"), "key", "left_semi").withColumn("op", F.lit("delete")))

    def update(self, key: str, custom: dict) -> None:
        """Replace the custom map (values become strings); content and created_at stay."""
        if not key:
            raise InvalidKey("empty")
        values = F.create_map(*[F.lit(x) for k, v in custom.items() for x in (k, custom_string(v))]).cast("map<string,string>") if custom else F.create_map().cast("map<string,string>")

        def rows(v: Version) -> DataFrame:
            own = self.refs(v).where(F.col("key") == key)
            if own.limit(1).count() == 0:
                raise NotFound("key", key)
            return own.withColumns({"op": F.lit("update"), "custom": values, "updated_at": F.current_timestamp()})

        self._append(rows)

    def rename(self, old: str, new: str) -> None:
        """Move a reference in one commit; its metadata stays, timestamps included."""
        if not old or not new:
            raise InvalidKey("empty")

        def rows(v: Version) -> DataFrame:
            there = {r.key for r in self.refs(v).where(F.col("key").isin(old, new)).select("key").collect()}
            if old not in there:
                raise NotFound("key", old)
            if new in there:
                raise AlreadyExists("key", new)
            own = self.refs(v).where(F.col("key") == old)
            return own.withColumn("op", F.lit("delete")).unionByName(own.withColumns({"op": F.lit("put"), "key": F.lit(new)}))

        self._append(rows)

    # -- reading ----------------------------------------------------------------------------------

    def head(self, key: str):
        """Metadata of one key."""
        if not key:
            raise InvalidKey("empty")
        row = self.refs().where(F.col("key") == key).first()
        if row is None:
            raise NotFound("key", key)
        return row

    def list(self, prefix: str = "", after: str | None = None, limit: int = 0) -> DataFrame:
        return references.list_keys(self.refs(), prefix=prefix, after=after, limit=limit)

    def _resolved(self, wanted: DataFrame, version: Version, only: Sequence[str] | None = None) -> DataFrame:
        """Chunk rows (of ``wanted``, with chunk_id) with their plain payloads. ``only`` are all ids in
        it, where they are few: they are pushed to the scan."""
        record = self._record(version)
        stored = self._table(version, "chunks", CHUNKS).select("chunk_id", "nonce", "tag", "payload", "crc32")
        if only is not None:
            stored = stored.where(F.col("chunk_id").isin(*only))
        got = wanted.join(stored, "chunk_id", "left")
        good = F.when(F.col("payload").isNull(), F.raise_error(F.concat(F.lit("chunk not found: "), F.col("chunk_id"))).cast("binary")).when(F.crc32("payload") != F.col("crc32"), F.raise_error(F.concat(F.lit("crc mismatch: "), F.col("chunk_id"))).cast("binary")).otherwise(F.col("payload"))
        got = got.withColumn("payload", good)
        if record["encryption"]:
            got = got.withColumn("payload", open_sealed("nonce", "tag", "payload", self.store._data_key(record), "chunk_id"))
        return got.drop("nonce", "tag", "crc32")

    def _manifest(self, version: Version) -> DataFrame:
        return self._table(version, "manifests", MANIFESTS).select("blob_id", "chunks")

    def get_many(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, size, content) of the given keys, or of all; absent keys give no row."""
        v = self.store.log.head()
        refs = self.refs(v).select("key", "blob_id")
        if keys is not None:
            refs = refs.join(keys.select("key").distinct(), "key", "left_semi")
        wanted = refs.join(self._manifest(v), "blob_id").select("key", F.explode("chunks").alias("c")).select("key", "c.*")
        return chunks.reassemble(self._resolved(wanted, v), ["key"]).select("key", "size", "content")

    def _pieces(self, key: str, version: Version, start: int, stop: int) -> bytes:
        """Bytes [start, stop) of one object: its chunk ids first, then those chunks alone."""
        row = self.refs(version).where(F.col("key") == key).join(self._manifest(version), "blob_id").select(F.filter("chunks", lambda c: (c["offset"] < stop) & (c["offset"] + c["length"] > start)).alias("chunks")).first()
        if row is None:
            raise NotFound("key", key)
        if not row.chunks:
            return b""
        ids = sorted({c.chunk_id for c in row.chunks})
        wanted = self.store.spark.createDataFrame([(key, c.seq, c.chunk_id, c.offset, c.length) for c in row.chunks], "key string, seq int, chunk_id string, offset long, length long")
        got = self._resolved(wanted, version, ids if len(ids) <= _PUSHED else None)
        first = F.greatest(F.lit(start) - F.col("offset"), F.lit(0).cast("long"))
        last = F.least(F.lit(stop) - F.col("offset"), F.col("length"))
        parts = got.select("seq", F.col("payload").substr((first + 1).cast("int"), (last - first).cast("int")).alias("part"))
        return b"".join(bytes(r.part) for r in parts.orderBy("seq").toLocalIterator())

    def get(self, key: str) -> bytes:
        if not key:
            raise InvalidKey("empty")
        return self._pieces(key, self.store.log.head(), 0, 1 << 62)

    def read_ranges(self, ranges: DataFrame) -> DataFrame:
        """(key, start, stop, bytes) for half-open ranges (key, start, stop) of objects.

        The manifest alone tells which chunks overlap; only their payloads are joined.
        """
        v = self.store.log.head()
        asked = ranges.select("key", "start", "stop")
        refs = self.refs(v).select("key", "blob_id").join(asked, "key").join(self._manifest(v), "blob_id")
        over = F.filter("chunks", lambda c: (c["offset"] < F.col("stop")) & (c["offset"] + c["length"] > F.col("start")))
        wanted = refs.select("key", "start", "stop", F.explode(over).alias("c")).select("key", "start", "stop", "c.*")
        return chunks.cut_ranges(self._resolved(wanted, v), ["key"])

    def read(self, key: str, start: int = 0, length: int | None = None) -> bytes:
        """Bytes from ``start`` (negative: from the end); past the end gives none."""
        version = self.store.log.head()
        size = self.head(key).size
        if start < 0:
            start += size
        if start < 0:
            raise ValueError("the position lies before the start")
        stop = size if length is None else min(size, start + length)
        if start >= stop:
            return b""
        return self._pieces(key, version, start, stop)

    def rebuild_manifests(self, pages: DataFrame) -> int:
        """Register objects whose chunks a scan found whole and whose manifests were lost; returns their number.

        ``pages``: blob_id, seq, total_chunks, chunk_id, length. Refused for encrypted namespaces, as the
        scan has no nonces.
        """
        count = [0]

        def build(base: Version):
            if self._record(base)["encryption"]:
                raise ValueError("an encrypted namespace cannot be rebuilt from a scan")
            found = maintenance.rebuild_manifests(pages, ["blob_id"]).join(self._table(base, "manifests", MANIFESTS).select("blob_id"), "blob_id", "left_anti")
            before = F.aggregate("chunks", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(ArrayType(_ENTRY)).alias("out")), lambda a, c: F.struct((a["at"] + c["length"]).alias("at"), F.concat(a["out"], F.array(F.struct(c["seq"].cast("int").alias("seq"), c["chunk_id"].alias("chunk_id"), a["at"].alias("offset"), c["length"].cast("long").alias("length")))).alias("out")))["out"]
            rows = found.select(F.lit(self.uid).alias("ns_uid"), "blob_id", F.col("total_size").cast("long").alias("total_size"), F.current_timestamp().alias("created_at"), before.alias("chunks"))
            folders = self.store._stage("manifests", rows, base)
            count[0] = self.store.log.scan("manifests", folders, MANIFESTS).count()
            return {"manifests": folders}, {}, {}

        self.store._change(build)
        return count[0]

    def replay(self, entries: DataFrame) -> int:
        """Register the objects of write-ahead-log entries (see ``sources.read_wal``) that no manifest
        knows; returns their number. Chunks that the store lacks leave an object out. Repeatable."""
        v = self.store.log.head()
        lost = maintenance.unregistered(entries, self._table(v, "manifests", MANIFESTS))
        pages = lost.select("blob_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("seq", "c")).select("blob_id", "seq", "total_chunks", "c.chunk_id", "c.length")
        return self.rebuild_manifests(pages.join(self._table(v, "chunks", CHUNKS).select("chunk_id").distinct(), "chunk_id", "left_semi"))
