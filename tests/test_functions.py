import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn import functions as fn


def one(spark, expr, value="x", kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("r")).first().r


def test_ids(spark):
    assert one(spark, fn.blob_id("v"), b"hello", "binary") == "sha256:" + hashlib.sha256(b"hello").hexdigest()
    assert one(spark, F.crc32("v"), b"hello", "binary") == zlib.crc32(b"hello")
    blob = "sha256:" + "a" * 64
    assert one(spark, fn.legacy_chunk_id("v", F.lit(7)), blob) == blob + "#7"
    with pytest.raises(Exception, match="malformed"):
        one(spark, fn.legacy_chunk_id("v", F.lit(7)), "sha256:short")
    assert one(spark, fn.segment_hex(F.lit(255))) == "00000000000000ff"
    assert one(spark, fn.etag("v"), blob) == f'"{blob}"'


@pytest.mark.parametrize("length,pages", [(0, 1), (1, 1), (16296, 1), (16297, 2), (40000, 3)])
def test_page_count(spark, length, pages):
    assert one(spark, fn.page_count("v"), length, "long") == pages


@pytest.mark.parametrize("size,block,n", [(0, 4, 0), (1, 4, 1), (8, 4, 2), (9, 4, 3), (9, 0, 0), (9, -1, 0)])
def test_block_count(spark, size, block, n):
    assert one(spark, fn.block_count("v", F.lit(block)), size, "long") == n


@pytest.mark.parametrize("name,good", [("ab", True), ("a", False), ("a-b_c9", True), ("-ab", False), ("Ab", False), ("a" * 63, True), ("a" * 64, False), ("ab\n", False), ("a:b", False), ("", False), (None, False)])
def test_namespace_id(spark, name, good):
    assert one(spark, fn.is_namespace_id("v"), name) is good


def test_small_predicates(spark):
    assert one(spark, fn.is_uid("v"), "a_b-9") and not one(spark, fn.is_uid("v"), "..") and not one(spark, fn.is_uid("v"), "a" * 65)
    assert one(spark, fn.is_session_id("v"), "0" * 32) and not one(spark, fn.is_session_id("v"), "G" * 32)
    assert one(spark, fn.first_non_empty(F.lit(""), F.lit(None), "v"), "z") == "z" and one(spark, fn.first_non_empty(F.lit(None)), "z") == ""
    assert one(spark, fn.effective_uid(F.lit(""), "v"), "name") == "name"
    assert one(spark, fn.has_flag("v", 2), 3, "int") and one(spark, fn.set_flag("v", 4), 1, "int") == 5 and one(spark, fn.clear_flag("v", 1), 5, "int") == 4
    assert one(spark, fn.flags_of_magic(fn.encode_magic_flags("v")), 5, "int") == 5 and one(spark, fn.flags_of_magic("v"), 5, "long") is None


@pytest.mark.parametrize("text,slug", [("Hello, World!", "hello-world"), ("  --  ", "movie"), ("", "movie"), (None, "movie"), ("A1 b2", "a1-b2")])
def test_slug(spark, text, slug):
    assert one(spark, fn.slugify("v"), text) == slug


@pytest.mark.parametrize("name,safe", [("a/b/c.txt", "c.txt"), ("..", None), ("", None), ("x\\y.bin", "y.bin"), ("a\0b", None)])
def test_filename(spark, name, safe):
    assert one(spark, fn.safe_filename("v"), name) == safe


@pytest.mark.parametrize(
    "content,kind",
    [
        (b"\x89PNG\r\n\x1a\nxxxx", "image/png"), (b"%PDF-1.4 x", "application/pdf"), (b"plain words", "text/plain; charset=utf-8"), (b'{"a": 1}', "application/json"), (b"[1, 2]", "application/json"),
        (b"{broken", "text/plain; charset=utf-8"), (b"<!DOCTYPE html><html></html>", "text/html; charset=utf-8"), (b"\x00\x01\x02", "application/octet-stream"), (b"", "application/octet-stream"), (None, "application/octet-stream"),
        ('{"k": "' .encode() + b"x" * 5000 + b'"}', "application/json"), (b"RIFF\0\0\0\0WAVE", "audio/wav"), (b"xxxxxxxxWAVE", "text/plain; charset=utf-8"), ("é è".encode(), "text/plain; charset=utf-8"),
    ],
)
def test_content_type(spark, content, kind):
    assert one(spark, fn.content_type("v"), content, "binary") == kind


def test_declared_type_wins(spark):
    assert one(spark, fn.content_type("v", F.lit("text/x")), b'{"a":1}', "binary") == "text/x"
    assert one(spark, fn.content_type("v", F.lit("")), b'{"a":1}', "binary") == "application/json"


def test_seal_and_open(spark):
    key, other = fn.generate_key(), fn.generate_key()
    df = spark.createDataFrame([("id1", b"secret payload"), ("id2", b"\0" * 100)], "id string, p binary").select("id", "p", fn.seal("p", fn.hidden_key(key), "id").alias("s"))
    rows = df.select("id", F.col("p").alias("plain"), "s.*").collect()
    assert all(len(r.nonce) == 12 and len(r.tag) == 16 and len(r.payload) == len(r.plain) and r.payload != r.plain for r in rows)
    back = spark.createDataFrame(rows)
    good = back.select(fn.open_sealed("nonce", "tag", "payload", fn.hidden_key(key), "id").alias("x"), "plain").collect()
    assert all(r.x == r.plain for r in good)
    bad = back.select(fn.open_sealed("nonce", "tag", "payload", fn.hidden_key(other), "id", strict=False).alias("x"), fn.open_sealed("nonce", "tag", "payload", fn.hidden_key(key), F.lit("else"), strict=False).alias("y")).collect()
    assert all(r.x is None and r.y is None for r in bad)
    with pytest.raises(Exception):
        back.select(fn.open_sealed("nonce", "tag", "payload", fn.hidden_key(other), "id")).collect()
    assert key.hex() not in df._jdf.queryExecution().toString().lower()


def test_wrap_key(spark):
    key, master = fn.generate_key(), fn.generate_key()
    wrapped = fn.wrap_key(spark, key, master)
    assert len(wrapped) == 60 and fn.unwrap_key(spark, wrapped, master) == key
    with pytest.raises(ValueError):
        fn.unwrap_key(spark, wrapped, fn.generate_key())
    with pytest.raises(ValueError):
        fn.hidden_key(b"short")


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=20000), st.integers(4, 3000))
def test_chunker_contract(data, average):
    from cairn.operators.cdc import Chunker

    c = Chunker(average)
    parts = c.split(data)
    assert b"".join(parts) == data and all(1 <= len(p) <= c.most for p in parts) and all(len(p) >= c.least for p in parts[:-1]) and c.split(data) == parts
