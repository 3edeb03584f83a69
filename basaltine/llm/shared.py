"""Intermediate tables in the folder that driver and executors share, and packed arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .graph import folder


def written(df: DataFrame, *parts: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, split into files by the columns `parts`."""
    path = folder(df.sparkSession)
    df.write.option("compression", "snappy").partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pack(values: np.ndarray) -> bytes:
    """An integer array (ascending ones pack best) or any other array, compressed."""
    kind = values.dtype.str.encode()
    body = values
    if values.dtype.kind in "iu" and len(values):
        body = values.copy()
        body[1:] = values[1:] - values[:-1]
    if values.dtype.itemsize > 1:  # bytes of like weight together
        body = np.ascontiguousarray(body.view(np.uint8).reshape(len(values), -1).T)
    raw = body.tobytes()
    return kind + len(values).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    n = int.from_bytes(data[3:11], "little")
    if not n:
        return np.zeros(0, kind)
    body = np.frombuffer(pa.decompress(data[11:], n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(body.reshape(kind.itemsize, n).T).view(kind).ravel() if kind.itemsize > 1 else body.view(kind)
    return np.cumsum(values, dtype=kind) if kind.kind in "iu" else values


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of what `df` reads (for tables in files, their size)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
