"""MIME type from an object's first bytes, as one column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW = 3072
_MAGIC: list[tuple[int, str, str]] = [  # offset, hex, type
    (0, "89504E470D0A1A0A", "image/png"), (0, "FFD8FF", "image/jpeg"), (0, "474946383761", "image/gif"), (0, "474946383961", "image/gif"), (8, "57454250", "image/webp"),
    (0, "424D", "image/bmp"), (0, "49492A00", "image/tiff"), (0, "4D4D002A", "image/tiff"), (0, "00000100", "image/x-icon"), (0, "25504446", "application/pdf"),
    (0, "504B0304", "application/zip"), (0, "504B0506", "application/zip"), (0, "1F8B", "application/gzip"), (0, "425A68", "application/x-bzip2"), (0, "FD377A585A00", "application/x-xz"),
    (0, "28B52FFD", "application/zstd"), (0, "377ABCAF271C", "application/x-7z-compressed"), (0, "526172211A07", "application/x-rar-compressed"), (257, "7573746172", "application/x-tar"), (8, "57415645", "audio/wav"),
    (8, "41564920", "video/x-msvideo"), (0, "4F676753", "application/ogg"), (0, "664C6143", "audio/flac"), (0, "494433", "audio/mpeg"), (0, "FFFB", "audio/mpeg"), (4, "66747970", "video/mp4"),
    (0, "1A45DFA3", "video/webm"), (0, "7F454C46", "application/x-elf"), (0, "4D5A", "application/vnd.microsoft.portable-executable"), (0, "CAFEBABE", "application/x-java-applet"), (0, "0061736D", "application/wasm"),
    (0, "53514C69746520666F726D6174203300", "application/vnd.sqlite3"), (0, "50415231", "application/vnd.apache.parquet"), (0, "774F4646", "font/woff"), (0, "774F4632", "font/woff2"),
]
_RIFF = ("image/webp", "audio/wav", "video/x-msvideo")
_HTML = r"(?is)\A\s*(?:<!--.*?-->\s*)*<(?:!doctype html|html|head|script|iframe|h1|div|font|table|a|style|title|b|body|br|p)[\s>]"


def content_type(content: Column | str, declared: Column | str | None = None) -> Column:
    """The declared type where there is one, else the type that the first 3,072 bytes show.

    Checked in order: magic numbers, markup, JSON, text, and ``application/octet-stream`` for all
    else (also for empty content). A JSON text must start with an object or array; up to the window
    it must parse as a whole, beyond it the start decides.
    """
    c = F.col(content) if isinstance(content, str) else content
    head = F.substring(c, 1, WINDOW)
    latin = F.decode(head, "ISO-8859-1")
    kind = F.lit(None).cast("string")
    text = ~latin.rlike(r"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]") & (F.length(head) > 0)
    json_like = latin.rlike(r"\A\s*[\[{]") & F.when(F.length(c) > WINDOW, latin.rlike(r'\A\s*(?:\{\s*"|\[\s*(?:[\[{"0-9-]|true|false|null))')).otherwise(F.try_parse_json(F.try_to_binary(F.hex(head), F.lit("hex")).cast("string")).isNotNull())
    kind = (
        F.when(head.isNull() | (F.length(head) == 0), "application/octet-stream")
        .when(latin.rlike(_HTML), "text/html; charset=utf-8")
        .when(latin.rlike(r"(?is)\A\s*(?:<\?xml.*?\?>\s*)?(?:<!--.*?-->\s*)*(?:<!doctype svg[^>]*>\s*)?<svg[\s>]"), "image/svg+xml")
        .when(latin.rlike(r"(?i)\A\s*<\?xml\s"), "text/xml; charset=utf-8")
        .when(text & json_like, "application/json")
        .when(F.substring(head, 1, 2).isin(b"\xff\xfe", b"\xfe\xff"), "text/plain; charset=utf-16")
        .when(text, "text/plain; charset=utf-8")
        .otherwise("application/octet-stream")
    )
    for offset, magic, name in reversed(_MAGIC):
        hit = F.substring(head, offset + 1, len(magic) // 2) == F.lit(bytes.fromhex(magic))
        if name in _RIFF:
            hit &= F.substring(head, 1, 4) == F.lit(b"RIFF")
        kind = F.when(hit, name).otherwise(kind)
    if declared is None:
        return kind
    given = F.col(declared) if isinstance(declared, str) else declared
    return F.coalesce(F.nullif(given, F.lit("")), kind)
