import struct
import zlib

from cairn.sources import binary_files, read_wal, scan_segments


def _segment(page, chunks):
    out = struct.pack("<IHHQI", 0xB10B5EED, 1, 0, 1, page)[:8] + struct.pack("<Q", 1) + struct.pack("<I", page)
    out = out.ljust(128, b"\0")
    for i, body in enumerate(chunks):
        head = struct.pack("<Q32s32sIIII", len(body), bytes([i] * 32), b"\1" * 32, i, len(chunks), zlib.crc32(body), 0xB10B5E00 | (2 if i == len(chunks) - 1 else 0))
        out += (head + body).ljust(page, b"\0")
    return out


def test_segments(spark, tmp_path):
    (tmp_path / "seg-0000000000000001.vol").write_bytes(_segment(256, [b"one", b"two!"]) + b"\0" * 256)
    (tmp_path / "seg-0000000000000002.vol").write_bytes(b"short")
    rows = scan_segments(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(bytes(r.payload), r.length, r.total_chunks, r.flags) for r in rows] == [(b"one", 3, 2, 0), (b"two!", 4, 2, 2)]
    assert all(zlib.crc32(r.payload) == r.crc32 for r in rows)


def test_wal(spark, tmp_path):
    def entry(blob, chunks):
        out = struct.pack("<IH", 0x0BA1FACE, len(blob)) + blob + struct.pack("<I", len(chunks))
        for c in chunks:
            out += struct.pack("<H", len(c)) + c + struct.pack("<QQQ", 1, 2, 3)
        return out

    data = entry(b"b1", [b"c1", b"c2"]) + entry(b"b2", [b"c3"])
    (tmp_path / "seg-0000000000000001.wal").write_bytes(data + entry(b"torn", [b"c4"])[:-5])
    rows = read_wal(spark, str(tmp_path)).orderBy("entry", "pos").collect()
    assert [(r.blob_id, r.chunk_id, r.length) for r in rows] == [("b1", "c1", 3), ("b1", "c2", 3), ("b2", "c3", 3)]


def test_binary_files(spark, tmp_path):
    (tmp_path / "x.json").write_bytes(b"{}")
    row = binary_files(spark, str(tmp_path)).first()
    assert row.content_type == "application/json" and row["size"] == 2
