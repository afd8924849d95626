"""Column functions: identifiers, predicates, MIME sniffing, sealing."""

from .crypto import generate_key, hidden_key, open_sealed, seal, unwrap_key, wrap_key
from .scalar import (
    block_count,
    blob_id,
    chunk_id,
    clear_flag,
    effective_uid,
    encode_magic_flags,
    etag,
    first_non_empty,
    flags_of_magic,
    has_flag,
    is_namespace_id,
    is_session_id,
    is_uid,
    legacy_chunk_id,
    page_count,
    safe_filename,
    segment_hex,
    set_flag,
    slugify,
)
from .sniff import content_type

__all__ = [
    "blob_id", "block_count", "chunk_id", "clear_flag", "content_type", "effective_uid", "encode_magic_flags", "etag", "first_non_empty", "flags_of_magic",
    "generate_key", "has_flag", "hidden_key", "is_namespace_id", "is_session_id", "is_uid", "legacy_chunk_id", "open_sealed", "page_count", "safe_filename", "seal",
    "segment_hex", "set_flag", "slugify", "unwrap_key", "wrap_key",
]
