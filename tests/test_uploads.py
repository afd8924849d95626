import hashlib
from datetime import timedelta

import pytest

from cairn.errors import Corruption, InvalidKey, NotFound
from cairn.operators import maintenance
from cairn.store import ObjectStore, Options
from cairn.uploads import UploadManager, check_session

SHA = hashlib.sha256(b"0123456789").hexdigest()


def test_session_rules():
    good = dict(ns="n", key="k", size=8, sha256="", block_size=4, piece_hashes=[SHA, SHA])
    check_session(**good)
    for change in ({"size": -1}, {"block_size": -1}, {"block_size": 0}, {"size": 0, "piece_hashes": []}, {"size": 9}, {"piece_hashes": [SHA]}, {"piece_hashes": [SHA, "x"]}, {"sha256": "ab"}):
        with pytest.raises(ValueError):
            check_session(**{**good, **change})
    with pytest.raises(InvalidKey):
        check_session(**{**good, "key": ""})


def test_upload(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/s", Options(chunk_size=64))
    ns = store.create_namespace("one")
    up = UploadManager(store, f"file://{tmp_path}/u")
    a = up.begin("one", "k", size=10, sha256=SHA.upper(), content_type="text/x", custom={"a": "b"})
    up.write(a, 5, b"56789")
    with pytest.raises(ValueError, match="bounds"):
        up.write(a, 8, b"toolong")
    with pytest.raises(ValueError, match="checksum"):
        up.write(a, 0, b"01234", "00")
    with pytest.raises(ValueError, match="5 of 10"):
        up.complete(a)
    assert up.offset(a) == 5
    up.write(a, 0, b"XXXXX")
    with pytest.raises(Corruption):
        up.complete(a)
    up.write(a, 0, b"01234")
    ref = up.complete(a)
    assert (ref.content_type, ref.custom, ns.get("k")) == ("text/x", {"a": "b"}, b"0123456789")
    for gone in (lambda: up.offset(a), lambda: up.abort(a), lambda: up.write(a, 0, b"x")):
        with pytest.raises(NotFound):
            gone()
    b = up.begin("one", "j", size=4)
    up.abort(b)
    up.begin("one", "i", size=4)
    assert up.reap(timedelta(days=1)) == 0 and up.reap(timedelta(0)) == 1 and up.sessions().count() == 0
    with pytest.raises(NotFound):
        up.begin("none", "k", size=1)


def test_replay(spark):
    entries = spark.createDataFrame([("s", 0, "b1", "c1", 5, 0), ("s", 0, "b1", "c2", 6, 1), ("s", 1, "b2", "c1", 5, 0), ("s", 2, "b1", "c1", 5, 0)], "segment string, entry long, blob_id string, chunk_id string, length long, pos int")
    known = spark.createDataFrame([("b2",)], "blob_id string")
    rows = maintenance.unregistered(entries, known).collect()
    assert [r.blob_id for r in rows] == ["b1"]
