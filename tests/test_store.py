import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.commits import CommitLog
from cairn.errors import AlreadyExists, Closed, Conflict, Corruption, EmptyObject, InvalidKey, InvalidNamespace, NotFound, QuotaExceeded, http_status
from cairn.functions import generate_key
from cairn.store import ObjectStore, Options, Quota


class Keys:
    def __init__(self):
        self.keys = {"v1": generate_key()}

    def current(self):
        return "v1", self.keys["v1"]

    def key(self, version):
        return self.keys[version]


@pytest.fixture
def store(spark, tmp_path):
    with ObjectStore(spark, f"file://{tmp_path}/store", Options(chunk_size=1024), Keys()) as s:
        yield s


def blob(n, seed=0):
    return random.Random(seed).randbytes(n)


def test_names_go_to_the_rows(spark, tmp_path):
    """Neither the check nor the statistics shuffle payloads by namespace."""
    store = ObjectStore(spark, f"file://{tmp_path}/s", Options(chunk_size=64, fixed=True))
    store.create_namespace("docs").put("k", b"x" * 1000)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
        for df in (store.verify(), store.stats()):
            assert "hashpartitioning(ns_uid" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_objects(store, spark):
    ns = store.create_namespace("one")
    data = blob(20_000)
    ref = ns.put("k/1", data, custom={"a": "b"})
    assert ref.blob_id == "sha256:" + hashlib.sha256(data).hexdigest() and ref.size == 20_000 and ns.get("k/1") == data
    ns.put("k/2", data)
    ns.put("text", b"plain text")
    assert ns.head("text").content_type.startswith("text/plain") and [r.key for r in ns.list(prefix="k/").collect()] == ["k/1", "k/2"]
    assert [r.key for r in ns.list(after="k/1", limit=1).collect()] == ["k/2"]
    s = store.stats().first()
    assert (s.blob_count, s.bytes_stored, s.bytes_physical) == (3, 40_010, 20_010) and store.store_stats().first().deduplication_ratio > 1.9
    assert ns.read("k/1", 100, 50) == data[100:150] and ns.read("k/1", -5) == data[-5:] and ns.read("k/1", 30_000) == b""
    with pytest.raises(ValueError):
        ns.read("k/1", -30_000)
    ns.update("k/1", {"n": 3})
    assert ns.head("k/1").custom == {"n": "3"} and ns.get("k/1") == data
    before = ns.head("k/1")
    ns.rename("k/1", "k/3")
    after = ns.head("k/3")
    assert (after.created_at, after.updated_at, after.custom) == (before.created_at, before.updated_at, before.custom)
    with pytest.raises(NotFound):
        ns.get("k/1")
    with pytest.raises(AlreadyExists):
        ns.rename("k/3", "k/3")
    with pytest.raises(NotFound):
        ns.rename("none", "x")
    with pytest.raises(NotFound):
        ns.update("none", {})
    ns.delete("k/3")
    ns.delete("k/3", "never")
    assert store.stats().first().dead_chunks == 0  # k/2 still needs the chunks
    ns.delete("k/2")
    assert store.stats().first().dead_bytes == 20_000
    done = store.compact(0.0)
    assert done["bytes_reclaimed"] == 20_000 and store.stats().first().bytes_physical == 10 and ns.get("text") == b"plain text"
    assert store.verify().count() == 0
    store.verify_first()


def test_rejections(store, spark):
    ns = store.create_namespace("limits", quota=Quota(max_bytes=100, max_blob_count=2, max_blob_size=60))
    for bad in (lambda: ns.put("", b"x"), lambda: ns.head(""), lambda: ns.delete(""), lambda: ns.rename("", "x"), lambda: ns.update("", {})):
        with pytest.raises(InvalidKey):
            bad()
    with pytest.raises(EmptyObject):
        ns.put("k", b"")
    twice = spark.createDataFrame([("k", b"1"), ("k", b"2")], "key string, content binary")
    with pytest.raises(InvalidKey):
        ns.put_many(twice)
    with pytest.raises(QuotaExceeded, match="blob_size"):
        ns.put("k", b"x" * 61)
    ns.put("k1", b"x" * 50)
    with pytest.raises(QuotaExceeded, match="bytes"):
        ns.put("k2", b"y" * 51)
    ns.put("k2", b"y" * 50)
    with pytest.raises(QuotaExceeded, match="blob_count") as e:
        ns.put("k3", b"z")
    assert http_status(e.value) == 507 and http_status(KeyError()) == 500
    with pytest.raises(InvalidNamespace):
        store.create_namespace("Bad:Name")
    with pytest.raises(AlreadyExists):
        store.create_namespace("limits")
    assert store.create_namespace("limits", if_not_exists=True).uid == ns.uid
    with pytest.raises(NotFound):
        store.namespace("none")
    for wrong in ({"chunk_size": 2}, {"page_size": 88}, {"rewrite_threshold": 2}, {"retries": 0}):
        with pytest.raises(ValueError):
            Options(**wrong)


def test_isolation_and_deletion(store, tmp_path):
    a, b = store.create_namespace("aa"), store.create_namespace("bb")
    data = blob(5000, 3)
    a.put("k", data)
    b.put("k", data)
    assert [r.bytes_physical for r in store.stats().orderBy("ns").collect()] == [5000, 5000]
    store.delete_namespace("aa")
    assert store.list_namespaces() == ["bb"] and b.get("k") == data
    with pytest.raises(NotFound):
        a.head("k")
    again = store.create_namespace("aa")
    assert again.uid != a.uid and again.refs().count() == 0
    assert store.cleanup_deleted() == 0
    files = [p for p in (tmp_path / "store").rglob("*") if f"ns_uid={a.uid}" in str(p)]
    assert not files


def test_encryption(store, spark, tmp_path):
    ns = store.create_namespace("sealed", encrypted=True)
    data = b"very secret words " * 300
    ns.put("k", data)
    assert ns.get("k") == data and ns.read("k", 1500, 30) == data[1500:1530] and store.verify().count() == 0
    assert all(r.payload is not None and len(r.nonce) == 12 and bytes(r.payload) not in data for r in store.chunk_rows().collect())
    ns.put("k2", data)
    assert store.stats().first().bytes_physical == len(data)
    store.compact(0.0)
    assert ns.get("k2") == data
    other = ObjectStore(spark, f"file://{tmp_path}/store", Options(chunk_size=1024), Keys())
    with pytest.raises(ValueError):
        other.namespace("sealed").get("k")
    with pytest.raises(ValueError):
        ObjectStore(spark, f"file://{tmp_path}/other").create_namespace("sealed", encrypted=True)
    with pytest.raises(ValueError):
        ns.rebuild_manifests(store.chunk_rows())


def test_rebuild(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/s", Options(chunk_size=100, fixed=True))
    ns = store.create_namespace("one")
    data = blob(250, 9)
    ns.put("k", data)
    log = store.log
    head = log.head()
    found = store.manifests().select("blob_id", F.explode("chunks").alias("c"), F.size("chunks").alias("total_chunks")).select("blob_id", "c.seq", "total_chunks", "c.chunk_id", "c.length")
    pages = spark.createDataFrame(found.collect())
    log.commit(head, {}, {"manifests": []}, head.info)
    assert [r.reason for r in store.verify().collect()] == ["manifest missing"]
    with pytest.raises(Corruption):
        store.verify_first()
    assert ns.rebuild_manifests(pages.where("seq > 0")) == 0 and ns.rebuild_manifests(pages) == 1 and ns.rebuild_manifests(pages) == 0
    assert ns.get("k") == data and store.verify().count() == 0
    store.close()
    with pytest.raises(Closed):
        store.list_namespaces()
    with pytest.raises(Closed):
        store.close()


def test_commit_conflict(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    base = log.head()
    log.commit(base, {"t": ["data/t/x"]})
    with pytest.raises(Conflict):
        log.commit(base, {"t": ["data/t/y"]})
    assert log.head().tables == {"t": ("data/t/x",)} and log.read(0).number == 0
