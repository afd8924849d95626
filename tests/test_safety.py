"""Crashes, concurrent writers, retention and secrets."""

import threading
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from cairn.commits import CommitLog, partition_of
from cairn.errors import AlreadyExists, Closed, Conflict, InvalidNamespace, UnsupportedFormat
from cairn.functions import generate_key, hidden_key, wrap_key
from cairn.operators import catalog
from cairn.store import ObjectStore, Options, custom_string
from cairn.uploads import UploadManager
from tests.test_store import Keys

ROW = "ns_uid string, v long"


def test_vacuum_spares_staged_and_recent_folders(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], ROW)
    staged = log.stage("t", rows, 1)
    other = CommitLog(spark, f"file://{tmp_path}/log")
    assert other.vacuum() == 0 and sorted(map(partition_of, staged)) == ["a", "b"]
    first = log.commit(log.head(), {"t": staged})
    assert other.table(first, "t", rows.schema).count() == 2 and other.table(first, "t", rows.schema, "a").first().v == 1
    again = log.stage("t", rows.where("ns_uid = 'a'"), 2)
    second = log.commit(first, {}, {"t": again + [f for f in staged if partition_of(f) == "b"]})
    assert log.vacuum(retention=60) == 0 and log.table(first, "t", rows.schema).count() == 2  # a reader of the older version
    time.sleep(1.1)
    assert log.vacuum(retention=1) == 1 and log.table(second, "t", rows.schema).count() == 2 and log.numbers() == [2]


def test_torn_commit_uses_up_its_number(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.commit(log.head(), {"t": ["data/t/x/p=1"]})
    (tmp_path / "log/_commits" / f"{2:020d}.json").write_text("")
    (tmp_path / "log/_commits" / f"_part-{2:020d}.json").write_text("{")
    head = log.head()
    assert head.number == 2 and head.tables == {"t": ("data/t/x/p=1",)}
    assert log.commit(head, {}).number == 3 and log.head().tables == head.tables
    assert log.vacuum(retention=0) == 0 and log.head().number == 3


def test_two_writers(spark, tmp_path):
    """Both batches arrive, numbered by the version that holds them, while a third handle vacuums."""
    root = f"file://{tmp_path}/s"
    a, b = (ObjectStore(spark, root, Options(chunk_size=64, fixed=True)) for _ in range(2))
    a.create_namespace("one")
    failed = []

    def put(store, name):
        try:
            for k in range(2):
                store.namespace("one").put(f"{name}{k}", f"{name}{k}".encode() * 50)
                store.log.vacuum()
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=put, args=x) for x in ((a, "x"), (b, "y"))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    got = {r.key: r.version for r in a.namespace("one").refs().collect()}
    assert sorted(got) == ["x0", "x1", "y0", "y1"] and len(set(got.values())) == 4
    assert a.verify().count() == 0 and bytes(b.namespace("one").get("y1")) == b"y1" * 50


def test_upload_arrivals_follow_commits(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/s", Options(chunk_size=64))
    store.create_namespace("one")
    up = UploadManager(store, f"file://{tmp_path}/u")
    s = up.begin("one", "k", size=4)
    real, done = up.log.commit, []

    def late(base, *args):
        if not done:
            done.append(1)
            UploadManager(store, f"file://{tmp_path}/u").write(s, 0, b"OLD!")
        return real(base, *args)

    up.log.commit = late
    up.write(s, 0, b"new!")
    assert [bytes(r.data) for r in up.parts().orderBy("arrival").collect()] == [b"OLD!", b"new!"]
    up.complete(s)
    assert store.namespace("one").get("k") == b"new!" and not [p for p in (tmp_path / "u/data").glob("checked/*")]
    t = up.begin("one", "j", size=4)
    stop = up.start_reaper(timedelta(milliseconds=50), timedelta(0))
    for _ in range(200):
        if up.sessions().count() == 0:
            break
        time.sleep(0.1)
    stop()
    assert up.sessions(session=t).count() == 0


def test_no_key_in_plans(spark, tmp_path):
    keys = Keys()
    key = generate_key()
    texts = [str(spark.range(1).select(F.aes_encrypt(hidden_key(key), hidden_key(keys.key("v1")), F.lit("GCM")))._jdf.queryExecution().toString())]
    from pyspark.sql.classic.dataframe import DataFrame

    seen = DataFrame.first

    def first(self):
        texts.append(self._jdf.queryExecution().toString())
        return seen(self)

    DataFrame.first = first
    try:
        wrapped = wrap_key(spark, key, keys.key("v1"))
    finally:
        DataFrame.first = seen
    assert len(wrapped) == 60 and len(texts) == 2
    for text in texts:
        for k in (key, keys.key("v1")):
            assert k.hex() not in text.lower().replace(" ", "") and repr(k) not in text


def test_namespaces_are_pruned_and_erased_by_folder(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/s", Options(chunk_size=64, fixed=True))
    a, b = store.create_namespace("aa"), store.create_namespace("bb")
    for k in range(3):
        a.put(f"k{k}", bytes([k]) * 200)
    b.put("k", b"b" * 200)
    assert b.refs().inputFiles() and a.uid not in str(b.refs().inputFiles())
    assert a.refs()._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2  # (initial and adaptive plan) one scan, however many commits
    before = {f for f in store.list_segments() if partition_of(f) == b.uid}
    store.delete_namespace("aa")
    assert set(store.list_segments()) == before and b.get("k") == b"b" * 200
    assert not [p for p in tmp_path.rglob(f"ns_uid={a.uid}")]


def test_pending_erasure_is_finished_at_open(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store = ObjectStore(spark, root, Options(chunk_size=64, fixed=True))
    ns = store.create_namespace("gone", uid="own-uid")
    ns.put("k", b"x" * 100)
    head = store.log.head()
    with pytest.raises(AlreadyExists):
        store.create_namespace("other", uid="own-uid")
    with pytest.raises(InvalidNamespace):
        store.create_namespace("other", uid="../x")
    store.log.commit(head, {}, {}, {**head.info, "namespaces": {}, "tombstones": {"own-uid": "gone"}})  # crashed after the unlink
    with pytest.raises(AlreadyExists):
        store.create_namespace("other", uid="own-uid")
    again = ObjectStore(spark, root)
    assert again.log.head().info["tombstones"] == {} and not [p for p in tmp_path.rglob("ns_uid=own-uid")]
    assert again.create_namespace("other", uid="own-uid").refs().count() == 0


def test_segments(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store = ObjectStore(spark, root, Options(chunk_size=64, fixed=True, merge_below=0, retention=3600))
    ns = store.create_namespace("one")
    for k in range(3):
        ns.put(f"k{k}", bytes([k]) * 100)
    folders = store.list_segments()
    assert len(folders) == 3 and store.active_segment() == folders[-1] and not store.is_dirty() and store.highest_segment() == store.log.head().number
    ns.delete("k0")
    assert [(r.segment, r.chunks_dead) for r in store.segment_stats().collect()] == [(folders[0], 2), (folders[1], 0), (folders[2], 0)]
    with pytest.raises(ValueError):
        store.delete_segment(folders[1])
    assert store.compact(1.0)["folders_rewritten"] == 1 and store.list_segments() == folders[1:]
    assert (tmp_path / "s" / folders[0]).exists()  # until the retention time is over
    store.delete_segment(folders[0])
    assert not (tmp_path / "s" / folders[0]).exists()
    left = store.log.stage("chunks", spark.read.parquet(f"{root}/{folders[1]}").withColumn("ns_uid", F.lit(ns.uid)), 99)
    assert store.is_dirty() and store.highest_segment() == 99 and left[0] not in store.list_segments()
    merging = ObjectStore(spark, root, Options(chunk_size=64, fixed=True))
    assert merging.compact()["folders_rewritten"] == 2 and len(merging.list_segments()) == 1 and ns.get("k2") == bytes([2]) * 100
    entries = spark.createDataFrame([("seg", 0, "sha256:new", r.chunk_id, r.length, i) for i, r in enumerate(store.chunk_rows().select("chunk_id", "length").collect())] + [("seg", 1, "sha256:bad", "sha256:none", 5, 0)], "segment string, entry long, blob_id string, chunk_id string, length long, pos int")
    assert ns.replay(entries) == 1 and ns.replay(entries) == 0


def test_format_and_close(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    store = ObjectStore(spark, root)
    assert store.format == 2
    head = store.log.head()
    store.log.commit(head, {}, {}, {**head.info, "format": 1})
    with pytest.raises(UnsupportedFormat):
        ObjectStore(spark, root)
    store = ObjectStore(spark, f"file://{tmp_path}/t")
    entered, leave = threading.Event(), threading.Event()

    def slow(base):
        entered.set()
        leave.wait(20)
        return {}, {}, {}

    worker = threading.Thread(target=lambda: store._change(slow))
    worker.start()
    assert entered.wait(20)
    with pytest.raises(TimeoutError):
        store.close(timeout=0.1)
    leave.set()
    worker.join()
    assert store.log.head().number == 2  # the running change was let through
    with pytest.raises(Closed):
        store.create_namespace("xx")
    for wrong in ({"segment_size": 100}, {"page_size": 2000, "segment_size": 1000, "chunk_size": 10}, {"retention": -1}, {"merge_below": -1}):
        with pytest.raises(ValueError):
            Options(**wrong)


@pytest.mark.parametrize("value,text", [(True, "true"), (None, "<nil>"), (3, "3"), ("x", "x"), (1.0, "1"), (1.5, "1.5"), (-0.25, "-0.25"), (123456.0, "123456"), (1e6, "1e+06"), (123456789.0, "1.23456789e+08"), (1e-5, "1e-05"), (0.0001, "0.0001"), (1e100, "1e+100"), (0.0, "0"), (float("inf"), "+Inf"), (0.1 + 0.2, "0.30000000000000004")])
def test_custom_values(value, text):
    assert custom_string(value) == text


def test_slugs_are_unique(spark):
    titles = ["a", "a", "a 2", "a", "b", "a 3", "a-2", "a 2 2", "", "movie", "a-01", "a 01"]
    got = [r.slug for r in catalog.unique_slugs(spark.createDataFrame(list(enumerate(titles)), "i int, t string"), "t", "i").orderBy("i").collect()]
    assert got == ["a", "a-2", "a-2-2", "a-3", "b", "a-3-2", "a-2-3", "a-2-2-2", "movie", "movie-2", "a-01", "a-01-2"]


def test_attachments(spark):
    parents = spark.createDataFrame([("p",), ("p",)], "key string")
    rows = spark.createDataFrame([("x", "p", 5), ("y", "p", 50), ("z", "q", 5), (None, None, None)], "key string, parent string, size long")
    assert {(r.key, r.reason) for r in catalog.attach(rows, parents, most=10).collect()} == {("x", None), ("y", "too large"), ("z", "parent not found"), (None, "parent not found")}
    assert {r.key for r in catalog.cascade(parents, rows).collect()} == {"p", "x", "y"}


def test_conflict_names_the_file(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    log.publish("_commits/x", "1")
    with pytest.raises(Conflict):
        log.publish("_commits/x", "2")
    assert log.text("_commits/x") == "1" and not list((tmp_path / "log/_commits").glob("_part*"))
