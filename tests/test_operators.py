import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.operators import catalog, cdc, chunks, maintenance, quota, references, stats, uploads


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.fixture(scope="module")
def objects(spark):
    rng = random.Random(5)
    base = bytes(rng.randrange(256) for _ in range(5000))
    data = [("a", "k1", base), ("a", "k2", base + b"tail"), ("b", "k1", base), ("a", "k3", b"x"), ("a", "empty", b""), ("a", "null", None)]
    return spark.createDataFrame(data, "ns string, key string, content binary")


def test_fixed_roundtrip(spark, objects):
    cut = chunks.fixed_chunks(chunks.addressed(objects).drop("size"), 512)
    stored = chunks.chunk_store(cut)
    manifest = chunks.manifests(cut)
    whole = chunks.reassemble(chunks.resolve(manifest, stored))
    want = {(r.ns, hashlib.sha256(r.content).hexdigest()) for r in objects.where("length(content) > 0").collect()}
    got = {(r.ns, hashlib.sha256(r.content).hexdigest()) for r in whole.collect()}
    assert got == want
    assert stored.where("ns = 'a'").count() == 10 + 1 + 1  # nine whole chunks are shared, two last ones and "x" are not
    broken = stored.where("length = 512")
    with pytest.raises(Exception, match="chunk not found"):
        chunks.reassemble(chunks.resolve(manifest, broken)).collect()


def test_new_and_reused_chunks(spark):
    have = spark.createDataFrame([("a", "1")], "ns string, chunk_id string")
    come = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "1")], "ns string, chunk_id string")
    assert rows(chunks.new_chunks(come, have)) == [("a", "2"), ("b", "1")]
    assert rows(chunks.reused_chunks(come, have)) == [("a", "1")]


def test_ranges(spark, objects):
    cut = chunks.fixed_chunks(objects.where("ns = 'a'"), 100)
    want = spark.createDataFrame([("a", "k1", 95, 205), ("a", "k1", 4990, 9999), ("a", "k1", 6000, 7000), ("a", "k3", 0, 1)], "ns string, key string, start long, stop long")
    data = {r.key: r.content for r in objects.where("ns = 'a'").collect()}
    got = {(r.key, r.start): bytes(r.bytes) for r in chunks.read_ranges(cut, want, ["ns", "key"]).collect()}
    assert got == {("k1", 95): data["k1"][95:205], ("k1", 4990): data["k1"][4990:], ("k3", 0): b"x"}
    assert rows(chunks.locate(cut, 250, ["ns", "key"]), "key", "seq", "inner") == [("k1", 2, 50), ("k2", 2, 50)]
    assert rows(chunks.with_offsets(cut.drop("offset"), ["ns", "key"]).where("seq = 3 and key = 'k1'"), "offset") == [(300,)]


def test_cdc_batches_are_bounded(spark):
    """Whatever a batch brings, rows go out a few at a time."""

    class Frame:
        columns, schema = ["id", "content"], spark.createDataFrame([], "id long, content binary").schema
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    data = [np.random.default_rng(i).integers(0, 256, 20_000, dtype=np.uint8).tobytes() for i in range(40)]
    come = pa.RecordBatch.from_pydict({"id": list(range(42)), "content": [*data, b"", None]})
    for payload in (False, True):
        out = list(cdc.content_chunks(Frame(), 16, with_payload=payload)(iter([come])))
        assert sum(b.num_rows for b in out) > 3 * 8192 and max(b.num_rows for b in out) <= 8192
        every = pa.Table.from_batches(out)
        assert sum(every["length"].to_pylist()) == 40 * 20_000
    assert b"".join(every["payload"].to_pylist()) == b"".join(data) and set(every["id"].to_pylist()) == set(range(40))


def test_cdc_shares_after_insertion(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, 400_000, dtype=np.uint8).tobytes()
    df = spark.createDataFrame([("x", a), ("y", b"prefix" * 500 + a), ("z", b""), ("n", None)], "key string, content binary")
    c = cdc.content_chunks(df, 4096)
    assert rows(chunks.reassemble(c, ["key"]).select("key", F.sha2("content", 256))) == [("x", hashlib.sha256(a).hexdigest()), ("y", hashlib.sha256(b"prefix" * 500 + a).hexdigest())]
    shared = chunks.shared_chunks(c, F.col("key") == "x", F.col("key") == "y").count()
    total = c.where("key = 'x'").count()
    assert shared > 0.9 * total and 400_000 / 8192 <= total <= 400_000 / 2048
    with pytest.raises(ValueError):
        cdc.Chunker(3)


def test_chunk_udtf(spark):
    spark.udtf.register("chunk", cdc.chunk_udtf(64))
    got = spark.sql("SELECT count(*) AS n, sum(length) AS s FROM chunk(encode(repeat('abcdefg', 100), 'UTF-8'))").first()
    assert got.s == 700 and got.n >= 3


def test_listing(spark):
    refs = spark.createDataFrame([("n", k) for k in ("alpha", "beta", "gamma", "delta", "a_%")], "ns string, key string")
    keys = lambda **k: [r.key for r in references.list_keys(refs, ns="n", **k).collect()]
    assert keys() == ["a_%", "alpha", "beta", "delta", "gamma"] and keys(prefix="a_") == ["a_%"]
    assert keys(after="beta", limit=1) == ["delta"] and keys(after="absent") == ["alpha", "beta", "delta", "gamma"]
    asked = spark.createDataFrame([(0, "n", "beta"), (1, "n", "none")], "pos int, ns string, key string")
    assert [r.pos for r in references.multi_get(refs, asked).collect()] == [0, 1] and references.point_get(refs, "n", "none").count() == 0


def test_operation_log(spark):
    log = spark.createDataFrame(
        [("a", "k", "put", 1, 1, 10, "p1"), ("a", "k", "update", 2, 2, 0, "u1"), ("a", "k", "put", 3, 3, 20, "p2"), ("a", "j", "put", 1, 4, 5, "p"), ("a", "j", "delete", 2, 5, 0, None), ("a", "j", "update", 3, 6, 0, "u"), ("a", "i", "put", 1, 7, 1, "p"), ("a", "i", "update", 2, 8, 0, "u2"), ("a", "d", "delete", 1, 9, 0, None)],
        "ns string, key string, op string, ts int, version int, size int, custom string",
    )
    assert rows(references.live_refs(log), "key", "size") == [("i", 1), ("k", 20)]
    assert rows(references.superseded(log), "key", "size") == [("j", 5), ("k", 10)]
    assert rows(references.current_custom(log, F.col("custom")), "key", "custom") == [("i", "u2"), ("k", "p2")]


def test_rename(spark):
    refs = spark.createDataFrame([("a", k, i) for i, k in enumerate("wxyz")], "ns string, key string, v int")
    asked = spark.createDataFrame([("a", "w", "new"), ("a", "x", "new"), ("a", "y", "z"), ("a", "q", "r"), ("a", "z", "z")], "ns string, key string, new_key string")
    after, refused = references.rename(refs, asked)
    assert rows(after, "key", "v") == [("new", 0), ("x", 1), ("y", 2), ("z", 3)]
    assert rows(refused, "key", "reason") == [("q", "not found"), ("x", "already exists"), ("y", "already exists"), ("z", "already exists")]


def test_stats_of_nothing(spark):
    refs = spark.createDataFrame([], "ns string, key string, blob_id string, size long, chunk_count long")
    cut = spark.createDataFrame([], "ns string, chunk_id string, length long")
    spaces = spark.createDataFrame([("a",)], "ns string")
    per = stats.namespace_stats(refs, cut, spaces)
    assert rows(per) == [("a", 0, 0, 0, 0, 0)]
    assert stats.store_stats(per).first().deduplication_ratio == 0.0


def test_garbage(spark, objects):
    o = chunks.addressed(objects.where("length(content) > 0"))
    cut = chunks.fixed_chunks(o, 512)
    stored, manifest, refs = chunks.chunk_store(cut), chunks.manifests(cut), o.select("ns", "key", "blob_id", "size")
    assert maintenance.dead_chunks(stored, refs, manifest).count() == 0
    left = refs.where("not (ns = 'a' and key = 'k1')")
    assert maintenance.dead_chunks(stored, left, manifest).count() == 1  # only the last chunk isn't shared with k2
    assert maintenance.dead_manifests(manifest, left).count() == 1
    assert rows(stats.chunk_refcounts(refs, manifest).groupBy("ns").agg(F.max("ref_count"))) == [("a", 2), ("b", 1)]
    assert maintenance.verify(refs, manifest, stored).count() == 0
    hurt = stored.withColumn("payload", F.when(F.col("length") == 1, F.lit(b"y")).otherwise(F.col("payload")))
    assert rows(maintenance.verify(refs, manifest, hurt), "key", "reason") == [("k3", "crc mismatch")]
    forged = hurt.withColumn("crc32", F.crc32("payload"))
    assert rows(maintenance.verify(refs, manifest, forged), "key", "reason") == [("k3", "hash mismatch")]
    assert {r.reason for r in maintenance.verify(refs, manifest.where("total_size > 1"), stored).collect()} == {"manifest missing"}


def test_segments_and_rebuild(spark):
    seg = spark.createDataFrame([(1, 10, True), (1, 10, False), (2, 5, False), (3, 0, False)], "segment int, length long, dead boolean")
    out = stats.segment_stats(seg)
    assert rows(out, "segment", "dead_ratio") == [(1, 0.5), (2, 0.0), (3, 0.0)]
    assert rows(maintenance.compaction_candidates(out), "segment") == [(1,)] and maintenance.compaction_candidates(out, 0.0).count() == 3
    pages = spark.createDataFrame([("a", "b1", 0, 2, "c0", 5), ("a", "b1", 1, 2, "c1", 5), ("a", "b1", 1, 2, "c1", 5), ("a", "b2", 0, 2, "c0", 5)], "ns string, blob_id string, seq int, total_chunks int, chunk_id string, length long")
    assert rows(maintenance.rebuild_manifests(pages), "blob_id", "total_size") == [("b1", 10)]
    runs = spark.createDataFrame([("a", 1, 0, "c", 3, 10, False), ("a", 1, 1, "c", 0, 4, False), ("a", 1, 2, "d", 1, 7, True), ("a", 2, 0, "c", 3, 14, False)], "ns string, segment int, page_offset int, chunk_id string, total_chunks int, length long, deleted boolean")
    assert rows(maintenance.first_copies(runs), "chunk_id", "segment", "page_count", "length") == [("c", 1, 2, 14)]


def test_upgrade(spark):
    refs = spark.createDataFrame([("a", "x", "b1"), ("a", "y", "b1"), ("b", "z", "b1")], "ns string, key string, blob_id string")
    old = spark.createDataFrame([("b1", ["c1", "c1", "c2"]), ("b2", ["c3"]), ("b3", ["c4"])], "blob_id string, chunk_ids array<string>")
    counts = maintenance.upgrade_counts(refs, old)
    assert rows(counts) == [("a", "c1", 4), ("a", "c2", 2), ("b", "c1", 2), ("b", "c2", 1)]
    records = spark.createDataFrame([("b", "c1", 7), ("b", "c2", 8), ("a", "c3", 1), ("gone", "c4", 1)], "ns string, chunk_id string, length long")
    found = spark.createDataFrame([("a", "c1", 7)], "ns string, chunk_id string, length long")
    assert rows(maintenance.upgrade_chunks(counts, records, found), "ns", "chunk_id", "recovered") == [("a", "c1", "page"), ("a", "c2", "lost"), ("b", "c1", "record"), ("b", "c2", "record")]
    assert rows(maintenance.orphans(old, refs, spark.createDataFrame([("a",), ("b",)], "ns string"), records), "ns", "blob_id") == [("a", "b2")]


CASES = [([(0, 5), (3, 8)], [(0, 8)]), ([(0, 5), (5, 8)], [(0, 8)]), ([(6, 8), (0, 2)], [(0, 2), (6, 8)]), ([(4, 4), (5, 3), (-1, 2)], []), ([(0, 10), (2, 3)], [(0, 10)]), ([(0, 2), (0, 2)], [(0, 2)])]


def test_merge_ranges(spark):
    data = [(i, a, b) for i, (parts, _) in enumerate(CASES) for a, b in parts]
    got = uploads.merge_ranges(spark.createDataFrame(data, "session int, start long, stop long"))
    for i, (_, want) in enumerate(CASES):
        assert rows(got.where(F.col("session") == i), "start", "stop") == want


def test_range_predicates(spark):
    df = spark.createDataFrame([([(0, 10)],), ([(0, 4), (6, 10)],), ([],)], "r array<struct<start:long,stop:long>>")
    got = df.select(uploads.is_complete("r", 10), uploads.is_complete("r", 0), uploads.contains("r", 1, 3), uploads.total_bytes("r")).collect()
    assert [tuple(r) for r in got] == [(True, False, True, 10), (False, False, True, 8), (False, True, False, 0)]


def test_blocks(spark):
    b = spark.createDataFrame([("s", i) for i in [0, 1, 1, 129, 130, -1, 4000]], "session string, block long")
    size = 129 * 64 + 13  # 130 blocks, the last one of 13 bytes
    assert rows(uploads.block_progress(b, 64, size)) == [("s", 3, 2 * 64 + 13, False)]
    assert rows(uploads.block_ranges(b, 64, size)) == [("s", 0, 128), ("s", 129 * 64, size)]
    full = spark.range(130).select(F.lit("s").alias("session"), F.col("id").alias("block"))
    assert rows(uploads.block_progress(full, 64, size)) == [("s", 130, size, True)]
    part = spark.createDataFrame([(0, 64), (64, 13), (128, 13), (1, 64), (128, 64)], "o long, n long").select(uploads.valid_block_part(F.col("o"), F.col("n"), 64, 141).alias("v"))
    assert [r.v for r in part.collect()] == [True, False, True, False, False]


def test_upload_flow(spark):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    sessions = spark.createDataFrame(
        [("s1", 10, 0, sha(b"0123456789"), []), ("s2", 8, 4, None, [sha(b"abcd"), sha(b"efgh")]), ("s3", 4, 0, sha(b"else"), []), ("s4", 0, 0, None, []), ("s5", 6, 0, None, [])],
        "session string, expected_size long, block_size long, expected_sha256 string, piece_hashes array<string>",
    )
    parts = spark.createDataFrame(
        [("s1", 1, 5, b"56789", None), ("s1", 2, 0, b"XXXXX", None), ("s1", 3, 0, b"012345", None), ("s1", 4, 8, b"toolong", None), ("s1", 5, 0, b"0", "00"), ("s2", 1, 0, b"abcd", sha(b"abcd").upper()), ("s2", 2, 4, b"efgX", None), ("s2", 3, 2, b"zz", None), ("s3", 1, 0, b"none", None), ("s5", 1, 0, b"ab", None), ("s9", 1, 0, b"a", None)],
        "session string, arrival int, offset long, data binary, sha256 string",
    )
    checked = uploads.accept_parts(parts, sessions)
    assert rows(checked.where("reason is not null"), "session", "arrival", "reason") == [("s1", 4, "out of bounds"), ("s1", 5, "checksum mismatch"), ("s2", 3, "unaligned"), ("s9", 1, "unknown session")]
    done = uploads.completion(checked.where("reason is null"), sessions)
    assert {r.session: (r.state, r.received, bytes(r.content) if r.content is not None else None) for r in done.collect()} == {"s1": ("complete", 10, b"0123456789"), "s2": ("piece mismatch", 8, None), "s3": ("checksum mismatch", 4, None), "s4": ("complete", 0, b""), "s5": ("incomplete", 2, None)}


def test_retries_and_idle(spark):
    p = spark.createDataFrame([("s", 0, 5, 2, "b"), ("s", 0, 5, 1, "a")], "session string, start int, stop int, arrival int, v string")
    assert rows(uploads.first_arrivals(p, ["session", "start", "stop"], ["arrival"]), "v") == [("a",)]
    t = spark.createDataFrame([("s", 5), ("s", 9), ("r", 3)], "session string, ts int")
    assert rows(uploads.idle(t, F.lit(5))) == [("r", 3)]


def test_catalog(spark):
    c = spark.createDataFrame([("k1", "Zeta", "Drama", "a quiet FILM"), ("k2", "alpha", "drama", "loud"), ("k3", "Beta", "", "film noir")], "key string, title string, genre string, description string")
    assert [r.key for r in catalog.search(c, genre="DRAMA").collect()] == ["k2", "k1"]
    assert [r.key for r in catalog.search(c, query="Film").collect()] == ["k3", "k1"]
    assert [r.genre for r in catalog.facets(c).collect()] == ["Drama", "drama"]
    others = spark.createDataFrame([("k1",), ("k1",)], "key string")
    assert rows(catalog.with_flag(c, others, "key", "has"), "key", "has") == [("k1", True), ("k2", False), ("k3", False)]
    s = spark.createDataFrame([(1, "A b"), (2, "a-B"), (3, ""), (4, "?")], "i int, title string")
    assert rows(catalog.unique_slugs(s, "title", "i"), "i", "slug") == [(1, "a-b"), (2, "a-b-2"), (3, "movie"), (4, "movie-2")]
    names = spark.createDataFrame([("f",), ("f (1)",), ("f (3)",)], "key string")
    assert catalog.free_name(names, "f") == "f (2)" and catalog.free_name(names, "g") == "g"
    refs = spark.createDataFrame([("k", {"title": "T"}, 1, "x", None, None)], "key string, custom map<string,string>, size long, content_type string, created_at timestamp, updated_at timestamp")
    assert catalog.catalog_view(refs).first().title == "T"


def test_quota_sees_a_namespace_whole(spark):
    """The join starts as a sort-merge join and becomes a broadcast at run time, with its left side read locally."""
    ask = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("a"), F.col("id") % 2).alias("ns"), "id", F.lit(1).cast("long").alias("size"))
    limits = ask.select("ns").distinct().select("ns", F.lit(100).alias("max_blob_count"), F.lit(0).alias("max_bytes"), F.lit(0).alias("max_blob_size"))
    new = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        assert rows(quota.admit(ask, limits, order="id").where("reason is null"), "id") == [(i,) for i in range(200)]
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_quota(spark):
    asked = spark.createDataFrame([("a", 1, 60), ("a", 2, 60), ("a", 3, 30), ("a", 4, 5), ("b", 1, 10**9), ("c", 1, 40)], "ns string, t int, size long")
    limits = spark.createDataFrame([("a", 2, 100, 50), ("b", 0, 0, 0), ("c", 1, 0, 50)], "ns string, max_blob_count long, max_bytes long, max_blob_size long")
    assert sorted((r.ns, r.t, r.reason or "") for r in quota.admit(asked, limits, order="t").collect()) == [("a", 1, "blob_size"), ("a", 2, "blob_size"), ("a", 3, ""), ("a", 4, ""), ("b", 1, ""), ("c", 1, "")]
    used = limits.where("ns = 'c'").selectExpr("*", "1L AS used_count", "0L AS used_bytes")
    assert quota.admit(asked.where("ns = 'c'"), used, order="t").first().reason == "blob_count"
