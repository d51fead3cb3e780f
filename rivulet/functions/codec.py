"""Payload codecs that Spark has no function for: zlib and repeating-key XOR, as Arrow UDFs. base64 is built in.

XOR is kept to read old payloads; it protects nothing. New payloads take aes_encrypt.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType


@F.pandas_udf(BinaryType())
def _deflate(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.compress(x, 6))


@F.pandas_udf(BinaryType())
def _inflate(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else zlib.decompress(x))


def _xored(data: bytes | None, key: bytes) -> bytes | None:
    if data is None:
        return None
    own = np.frombuffer(data, np.uint8)
    return (own ^ np.resize(np.frombuffer(key, np.uint8), len(own))).tobytes()


@F.pandas_udf(BinaryType())
def _xor(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([_xored(x, k.encode()) for x, k in zip(data, key, strict=True)], dtype=object)


def _named(name: str, allowed: tuple[str, ...]) -> str:
    name = (name or "none").strip().lower()
    if name not in allowed:
        raise ValueError(f"unsupported codec '{name}'")
    return name


def encoded(payload: Column, compression: str = "zlib", encryption: str = "none", key: str = "") -> Column:
    """The payload (text) compressed, encrypted and in base64."""
    data = payload.cast("binary")
    if _named(compression, ("none", "zlib")) == "zlib":
        data = _deflate(data)
    kind = _named(encryption, ("none", "xor", "aes"))
    if kind != "none" and not key.strip():
        raise ValueError("encryption requires a key")
    data = _xor(data, F.lit(key.strip())) if kind == "xor" else F.aes_encrypt(data, F.lit(key.encode())) if kind == "aes" else data
    return F.base64(data)


def decoded(text: Column, compression: str = "zlib", encryption: str = "none", key: str = "") -> Column:
    """The payload of encoded()."""
    data = F.unbase64(text)
    kind = _named(encryption, ("none", "xor", "aes"))
    data = _xor(data, F.lit(key.strip())) if kind == "xor" else F.aes_decrypt(data, F.lit(key.encode())) if kind == "aes" else data
    if _named(compression, ("none", "zlib")) == "zlib":
        data = _inflate(data)
    return data.cast("string")


def metrics(payload: Column, wire: Column) -> Column:
    """struct(raw_bytes, wire_bytes, ratio, checksum): sizes before and after encoding, and the SHA-256 of the payload."""
    raw, sent = F.octet_length(payload).cast("long"), F.octet_length(wire).cast("long")
    return F.struct(raw.alias("raw_bytes"), sent.alias("wire_bytes"), F.round(sent / F.greatest(raw, F.lit(1)), 4).alias("ratio"), F.sha2(payload, 256).alias("checksum"))
