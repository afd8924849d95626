"""Resumable uploads over a store: sessions, parts in any order, completion, expiry.

Sessions and parts are tables of their own commit log, a folder a session, so that dropping one is a
change of the folder list. Parts are checked before they are stored, progress is always derived from
them, and a session's folders go only after its object is committed.
"""

from __future__ import annotations

import re
import secrets
import threading
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StringType, StructField, StructType, TimestampType

from .commits import CommitLog, Version, partition_of
from .errors import Conflict, Corruption, InvalidKey, NotFound
from .operators import uploads
from .store import ObjectStore

_S, _L = StringType(), LongType()
SESSIONS = StructType([StructField(n, t) for n, t in (("session", _S), ("ns", _S), ("key", _S), ("content_type", _S), ("custom", MapType(_S, _S)), ("expected_size", _L), ("expected_sha256", _S), ("block_size", _L), ("piece_hashes", ArrayType(_S)), ("created_at", TimestampType()))])
PARTS = StructType([StructField(n, t) for n, t in (("session", _S), ("arrival", _L), ("ts", TimestampType()), ("offset", _L), ("data", BinaryType()), ("sha256", _S))])
CHECKED = StructType([StructField(n, t) for n, t in (("session", _S), ("offset", _L), ("data", BinaryType()), ("sha256", _S), ("at", _L), ("reason", _S))])
_HASH = re.compile(r"[0-9a-f]{64}")


def check_session(ns: str, key: str, size: int, sha256: str, block_size: int, piece_hashes: Sequence[str]) -> None:
    """What a session must satisfy before it begins; ``ValueError`` names what it doesn't."""
    if not ns or not key:
        raise InvalidKey("namespace and key must not be empty")
    if sha256 and not _HASH.fullmatch(sha256):
        raise ValueError("the expected hash must have 64 hex digits")
    if size < 0 or block_size < 0:
        raise ValueError("sizes must not be negative")
    if not block_size and piece_hashes:
        raise ValueError("piece hashes need a block size")
    if block_size and not size:
        raise ValueError("a block size needs an expected size")
    if piece_hashes:
        if size % block_size:
            raise ValueError("with piece hashes the size must be a multiple of the block size")
        if len(piece_hashes) != size // block_size:
            raise ValueError("a piece hash is needed for every block")
        if not all(map(_HASH.fullmatch, piece_hashes)):
            raise ValueError("piece hashes must have 64 hex digits")


class UploadManager:
    def __init__(self, store: ObjectStore, root: str) -> None:
        self.store, self.spark = store, store.spark
        self.log = CommitLog(self.spark, root)

    def _change(self, build) -> Version:
        """Build on the newest version and commit; after a conflict all over again, so nothing staged
        or numbered for an older version is kept."""
        for left in range(self.store.options.retries, 0, -1):
            base = self.log.head()
            try:
                return self.log.commit(base, *build(base))
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    def sessions(self, version: Version | None = None, session: str | None = None) -> DataFrame:
        return self.log.table(version or self.log.head(), "sessions", SESSIONS, session)

    def parts(self, version: Version | None = None, session: str | None = None) -> DataFrame:
        return self.log.table(version or self.log.head(), "parts", PARTS, session)

    def begin(self, ns: str, key: str, *, size: int, sha256: str = "", content_type: str = "", custom: dict | None = None, block_size: int = 0, piece_hashes: Sequence[str] = ()) -> str:
        """A new session; returns its id of 32 hex digits."""
        sha256, hashes = sha256.lower(), [h.lower() for h in piece_hashes]
        check_session(ns, key, size, sha256, block_size, hashes)
        self.store.namespace(ns)
        name = secrets.token_hex(16)
        row = self.spark.createDataFrame([(name, ns, key, content_type, custom, size, sha256, block_size, hashes, datetime.now(timezone.utc))], SESSIONS)
        self._change(lambda base: ({"sessions": self.log.stage("sessions", row, base.number + 1, "session")},))
        return name

    def _session(self, name: str):
        row = self.sessions(session=name).first()
        if row is None:
            raise NotFound("session", name)
        return row

    def write_parts(self, parts: DataFrame) -> DataFrame:
        """Store parts (session, offset, data, and optionally sha256) of any sessions; returns the refused ones with a reason.

        ``parts`` is evaluated once. Arrival numbers follow the version that commits them, so of two
        writers the one that commits later counts as later; within a batch the given order holds.
        """
        if "sha256" not in parts.columns:
            parts = parts.withColumn("sha256", F.lit(None).cast("string"))
        rows = parts.select("session", "offset", "data", "sha256").withColumn("at", F.monotonically_increasing_id())
        head = self.log.head()
        batch = self.log.stage("checked", uploads.accept_parts(rows, self.sessions(head)), head.number + 1, "session")
        checked = self.log.scan("checked", batch, CHECKED)
        order = F.row_number().over(Window.partitionBy("session").orderBy("at"))

        def build(base: Version):
            stamp = (F.lit(base.number + 1).cast("long") * F.lit(1 << 40) + order).alias("arrival")
            rows = checked.where("reason is null").select("session", stamp, F.current_timestamp().alias("ts"), "offset", "data", "sha256")
            live = rows.join(self.sessions(base).select("session"), "session", "left_semi")
            return ({"parts": self.log.stage("parts", live, base.number + 1, "session")},)

        self._change(build)
        refused = checked.where("reason is not null").select("session", "offset", "reason")
        out = self.spark.createDataFrame(refused.collect(), refused.schema)  # a row a refused part
        self.log.drop({f.rpartition("/")[0] for f in batch})
        return out

    def write(self, name: str, offset: int, data: bytes, sha256: str | None = None) -> None:
        self._session(name)
        refused = self.write_parts(self.spark.createDataFrame([(name, offset, bytearray(data), sha256)], "session string, offset long, data binary, sha256 string")).first()
        if refused is not None:
            raise ValueError(refused.reason)

    def ranges(self, session: str | None = None) -> DataFrame:
        """Received byte ranges of one or all sessions as sorted arrays, with their total."""
        stop = F.col("offset") + F.octet_length("data")
        merged = uploads.merge_ranges(self.parts(session=session).select("session", F.col("offset").alias("start"), stop.cast("long").alias("stop")))
        return uploads.range_sets(merged).withColumn("received", uploads.total_bytes("ranges"))

    def offset(self, name: str) -> int:
        """Distinct bytes received so far."""
        self._session(name)
        row = self.ranges(name).first()
        return row.received if row else 0

    def complete(self, name: str):
        """Verify coverage, pieces and the whole hash, put the object, then drop the session."""
        row = self._session(name)
        version = self.log.head()
        state = uploads.completion(self.parts(version, name), self.sessions(version, name)).first()
        if state.state == "incomplete":
            raise ValueError(f"only {state.received} of {row.expected_size} bytes are here")
        if state.state != "complete":
            raise Corruption(state.state)
        ref = self.store.namespace(row.ns).put(row.key, bytes(state.content), row.content_type or None, row.custom)
        self._drop([name])
        return ref

    def abort(self, name: str) -> None:
        self._session(name)
        self._drop([name])

    def _drop(self, names: Sequence[str]) -> None:
        """Unlist the folders of sessions; no other session's parts are read or written."""
        gone = set(names)
        self._change(lambda base: ({}, {t: [f for f in base.tables.get(t, ()) if partition_of(f) not in gone] for t in base.tables}))
        self.log.vacuum(self.store.options.retention)

    def reap(self, max_age: timedelta) -> int:
        """Drop sessions without activity since ``max_age``; returns their number."""
        activity = self.sessions().select("session", F.col("created_at").alias("ts")).unionByName(self.parts().select("session", "ts"))
        cutoff = F.current_timestamp() - F.expr(f"INTERVAL {max_age.total_seconds():.6f} SECOND")
        names = [r.session for r in uploads.idle(activity, cutoff).select("session").collect()]
        if names:
            self._drop(names)
        return len(names)

    def start_reaper(self, every: timedelta, max_age: timedelta) -> Callable[[], None]:
        """Reap in the background every so often; returns what stops it (and waits for a run under way).

        A run that fails is left to the next one.
        """
        ended = threading.Event()

        def run() -> None:
            while not ended.wait(every.total_seconds()):
                try:
                    self.reap(max_age)
                except Exception:  # noqa: BLE001 - sessions stay, the next run tries again
                    continue

        thread = threading.Thread(target=run, daemon=True, name="cairn-reaper")
        thread.start()

        def stop() -> None:
            ended.set()
            thread.join()

        return stop
