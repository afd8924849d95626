"""Identifiers and predicates as plain column expressions (all inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELETED, LAST_CHUNK, COMPRESSED = 1, 2, 4
PAGE_HEADER = 88
_MAGIC = 0xB10B5E00


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blob_id(content: Column | str) -> Column:
    """Content address of an object: ``sha256:`` and 64 hex digits of the plain bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(_col(content), 256))


def chunk_id(payload: Column | str) -> Column:
    """Content address of a chunk; the same form as an object's."""
    return blob_id(payload)


def legacy_chunk_id(blob: Column | str, seq: Column | str) -> Column:
    """``<blob id>#<seq>`` of format 1; an error where the blob id isn't 71 long or seq isn't 32-bit."""
    b, s = _col(blob), _col(seq).cast("long")
    good = (F.length(b) == 71) & s.between(0, 2**32 - 1)
    return F.when(good, F.concat_ws("#", b, s.cast("string"))).otherwise(F.raise_error(F.lit("malformed blob id or sequence number")))


def segment_hex(segment: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(_col(segment).cast("long")), 16, "0"))


def page_count(length: Column | str, page_size: int = 16384) -> Column:
    """Pages that a payload fills; an empty one still takes a page."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(_col(length) / F.lit(page_size - PAGE_HEADER)).cast("long"))


def block_count(size: Column | str, block_size: Column | str) -> Column:
    s, b = _col(size).cast("long"), _col(block_size).cast("long")
    return F.when((b <= 0) | (s <= 0), F.lit(0).cast("long")).otherwise(F.expr("0L") + F.floor((s + b - 1) / F.nullif(b, F.lit(0))).cast("long"))


def etag(blob: Column | str) -> Column:
    return F.concat(F.lit('"'), _col(blob), F.lit('"'))


def slugify(text: Column | str, default: str = "movie") -> Column:
    """Lower-case ASCII letters and digits, other runs as one dash, none at the ends."""
    s = F.regexp_replace(F.lower(F.trim(_col(text))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^-+|-+$", ""), F.lit("")), F.lit(default))


def safe_filename(name: Column | str) -> Column:
    """Last path part; null where that is empty, dots only or holds NUL."""
    base = F.element_at(F.split(_col(name), r"[/\\]"), -1)
    return F.when(base.isin("", ".", "..") | base.contains("\0"), F.lit(None)).otherwise(base)


def first_non_empty(*cols: Column | str) -> Column:
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols], F.lit(""))


def effective_uid(uid: Column | str, name: Column | str) -> Column:
    return F.coalesce(F.nullif(_col(uid), F.lit("")), _col(name))


def is_namespace_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\A[a-z0-9][a-z0-9\-_]{0,61}[a-z0-9]\z"), F.lit(False))


def is_uid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\A[a-z0-9_-]{1,64}\z"), F.lit(False))


def is_session_id(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def has_flag(flags: Column | str, flag: int) -> Column:
    return _col(flags).bitwiseAND(F.lit(flag)) != 0


def set_flag(flags: Column | str, flag: int) -> Column:
    return _col(flags).bitwiseOR(F.lit(flag))


def clear_flag(flags: Column | str, flag: int) -> Column:
    return _col(flags).bitwiseAND(F.lit(0xFF & ~flag))


def encode_magic_flags(flags: Column | str) -> Column:
    return F.lit(_MAGIC).cast("long").bitwiseOR(_col(flags).cast("long").bitwiseAND(F.lit(0xFF)))


def flags_of_magic(word: Column | str) -> Column:
    """Flags of a page's magic word; null where the sentinel is wrong."""
    w = _col(word).cast("long")
    return F.when(w.bitwiseAND(F.lit(0xFFFFFF00)) == F.lit(_MAGIC), w.bitwiseAND(F.lit(0xFF)).cast("int"))
