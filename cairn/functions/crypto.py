"""AES-256-GCM sealing with detached nonce and tag; key wrapping.

A key never appears as a literal of a plan: ``hidden_key`` supplies it through a function whose
closure holds it, so that ``explain`` and the UI show the function's name only.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NONCE, TAG, KEY = 12, 16, 32


def generate_key() -> bytes:
    return os.urandom(KEY)


def hidden_key(key: bytes) -> Column:
    """The key as a column; evaluated by Arrow batch on the executors."""
    if len(key) != KEY:
        raise ValueError(f"a key has {KEY} bytes, not {len(key)}")

    @F.pandas_udf("binary")
    def data_key(like: pd.Series) -> pd.Series:
        return pd.Series([key] * len(like))

    return data_key.asNondeterministic()(F.lit(0))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seal(payload: Column | str, key: Column, aad: Column | str) -> Column:
    """struct(nonce, tag, payload); the payload keeps its length. The cipher runs once a row."""
    sealed = F.aes_encrypt(_c(payload), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), _c(aad))
    return F.transform(
        F.array(sealed),
        lambda s: F.struct(
            F.substring(s, 1, NONCE).alias("nonce"),
            s.substr(F.octet_length(s) - F.lit(TAG - 1), F.lit(TAG)).alias("tag"),
            s.substr(F.lit(NONCE + 1), F.octet_length(s) - F.lit(NONCE + TAG)).alias("payload"),
        ),
    )[0]


def open_sealed(nonce: Column | str, tag: Column | str, payload: Column | str, key: Column, aad: Column | str, strict: bool = True) -> Column:
    """The plain bytes. Any mismatch is an error, or null where ``strict`` is false."""
    open_ = F.aes_decrypt if strict else F.try_aes_decrypt
    return open_(F.concat(_c(nonce), _c(payload), _c(tag)), key, F.lit("GCM"), F.lit("DEFAULT"), _c(aad))


def wrap_key(spark, data_key: bytes, master: bytes) -> bytes:
    """nonce, tag and sealed key (60 bytes), without additional data. Neither key is in the plan."""
    row = spark.range(1).select(F.aes_encrypt(hidden_key(data_key), hidden_key(master), F.lit("GCM")).alias("s")).first()
    s = bytes(row.s)
    return s[:NONCE] + s[-TAG:] + s[NONCE:-TAG]


def unwrap_key(spark, wrapped: bytes, master: bytes) -> bytes:
    """The data key; ``ValueError`` where the master key or the bytes are wrong."""
    if len(wrapped) != NONCE + TAG + KEY:
        raise ValueError("malformed wrapped key")
    s = wrapped[:NONCE] + wrapped[NONCE + TAG :] + wrapped[NONCE : NONCE + TAG]
    row = spark.range(1).select(F.try_aes_decrypt(F.lit(s), hidden_key(master), F.lit("GCM")).alias("k")).first()
    if row.k is None:
        raise ValueError("the key cannot be unwrapped")
    return bytes(row.k)
