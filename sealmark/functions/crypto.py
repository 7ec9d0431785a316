"""Encrypted columns with key rotation. AES-GCM with a version prefix; unprefixed values are legacy plain text."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "enc:v1:"


def _key(secret: bytes) -> Column:
    return F.lit(bytearray(hashlib.sha256(secret).digest()))


def encrypt(value: Column, primary: bytes) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(value.cast("binary"), _key(primary)))))


def decrypt(value: Column, *keys: bytes) -> Column:
    """The first key that fits; null when none does. Values without the prefix are returned as they are."""
    raw = F.try_to_binary(F.substring(value, F.lit(len(PREFIX) + 1), F.length(value)), F.lit("base64"))
    tried = F.coalesce(*(F.try_aes_decrypt(raw, _key(k)).cast("string") for k in keys))
    return F.when(value.startswith(PREFIX), tried).otherwise(value)


def rotate(rows: DataFrame, column: str, primary: bytes, *retired: bytes) -> DataFrame:
    """rows with values that only a retired key reads encrypted under the primary key; others stay byte for byte."""
    value = F.col(column)
    stale = value.startswith(PREFIX) & decrypt(value, primary).isNull()
    opened = decrypt(value, *retired) if retired else F.lit(None).cast("string")
    return rows.withColumn(column, F.when(stale & opened.isNotNull(), encrypt(opened, primary)).otherwise(value))
