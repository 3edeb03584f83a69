"""Digests and compression of binary strings."""

from __future__ import annotations

import os
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def md5(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def sha1(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def sha2(c: Column, bits: int) -> Column:
    """Null unless bits is 0, 224, 256, 384 or 512."""
    return F.sha2(c.cast("binary"), bits) if bits in (0, 224, 256, 384, 512) else F.lit(None).cast("string")


def password(c: Column) -> Column:
    """A star and the digest of the digest's hex text; '' stays."""
    return F.when(c == "", "").otherwise(F.concat(F.lit("*"), F.sha1(F.sha1(c.cast("binary")).cast("binary"))))


def _compress(data: bytes | None) -> bytes | None:
    if not data:
        return data
    out = len(data).to_bytes(4, "little") + zlib.compress(data)
    return out + b"." if out.endswith(b" ") else out


def _uncompress(data: bytes | None) -> bytes | None:
    if not data:
        return data
    if len(data) <= 4:
        return None
    try:
        out = zlib.decompressobj().decompress(data[4:])
    except zlib.error:
        return None
    return out if len(out) <= int.from_bytes(data[:4], "little") else None


def compress(c: Column) -> Column:
    """zlib after the length in four bytes."""
    fn = F.pandas_udf(lambda s: s.map(_compress, na_action="ignore"), "binary")
    return _vector(fn, c)


def uncompress(c: Column) -> Column:
    """Null if the bytes are corrupt."""
    return _vector(F.pandas_udf(lambda s: s.map(_uncompress, na_action="ignore"), "binary"), c)


def _vector(fn, c: Column) -> Column:
    return fn(c.cast("binary"))


def uncompressed_length(c: Column) -> Column:
    b = c.cast("binary")
    little = F.conv(F.concat(*(F.hex(F.substring(b, i, 1)) for i in (4, 3, 2, 1))), 16, 10).cast("bigint")
    return F.when(F.octet_length(b) > 4, little).when(b.isNotNull(), 0).cast("bigint")


def random_bytes(n: Column) -> Column:
    """1 to 1024 random bytes."""

    def draw(s: pd.Series) -> pd.Series:
        if ((s < 1) | (s > 1024)).any():
            raise ValueError("length value is out of range in random_bytes")
        return s.map(lambda k: None if pd.isna(k) else os.urandom(int(k)))

    return F.pandas_udf(draw, "binary").asNondeterministic()(n.cast("int"))
