"""Vectorised text primitives shared by the corpus operators.

All functions work on one Arrow string array at a time, cut into slices of
bounded size (`slices`), so that a worker's memory doesn't depend on how long or
how many the documents of a partition are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once; one longer document makes a slice of its own.
SLICE_BYTES = 2 << 20

U64 = np.uint64


def held_out(id_col: str, mod: int, remainder: int = 2) -> Column:
    """True for rows whose crc32(id as text) mod `mod` is `remainder`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == remainder, F.lit(False))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns every text operator reads; a null text counts as empty."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the n + 1 offsets of the texts in it."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offs, data = texts.buffers()
    if len(texts) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    o = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, o - o[0]


def _trimmer():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: 0


_trim = _trimmer()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most `most` bytes of text each (or one row)."""
    if batch.num_rows == 0:
        return
    _, offs = buffer_of(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + most, side="right")) - 1
        end = max(at + 1, min(end, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end
    give_back()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 32 MB, so that long rows don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def over_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", most: int = SLICE_BYTES):
    """A function for mapInArrow that applies `fn` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                if (out := fn(part)) is not None:
                    yield out

    return run


# ---------------------------------------------------------------- words

def _fold_table() -> bytes:
    """ASCII letters to lower case; other ASCII but digits to a space; bytes of longer characters stay."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalnum() else 32
    return bytes(table)


_FOLD = _fold_table()


def fold(raw: np.ndarray) -> np.ndarray:
    """Case and ASCII punctuation folded away, byte for byte (offsets stay valid).

    Capitals of the Latin-1 block (two bytes, the first 0xC3) are lowered too.
    """
    out = np.frombuffer(raw.tobytes().translate(_FOLD), np.uint8).copy()
    lead = np.flatnonzero(out[:-1] == 0xC3) if len(out) else np.zeros(0, np.int64)
    if len(lead):
        nxt = out[lead + 1]
        capital = (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
        out[lead[capital] + 1] += 0x20
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on uint64 arrays (wraps round by design)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULT), ("down", _INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from prefix sums of a polynomial, in a few passes over the buffer."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    up, down = _powers(len(raw) + 1)
    prefix = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64))


class Words:
    """The words of a slice of texts: `doc` (row of the slice), `start` and `end` (bytes in the slice's buffer).

    A word is a run of folded bytes other than spaces and never crosses from one text into the next.
    """

    def __init__(self, texts: pa.Array, folded: bool = True):
        raw, self.offsets = buffer_of(texts)
        self.n_docs = len(texts)
        self.raw = fold(raw) if folded else raw
        inside = self.raw > 32 if not folded else self.raw != 32
        cut = np.zeros(len(self.raw) + 1, bool)
        cut[self.offsets] = True
        before = np.zeros(len(self.raw), bool)
        before[1:] = inside[:-1]
        before[cut[:-1]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(self.raw), bool)
        after[:-1] = inside[1:]
        after[cut[1:]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1

    def hashes(self) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, position of the first word) of every run of `n` words inside one document."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, doc.dtype), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    out = np.zeros(len(at), U64)
    for j in range(n):
        out = out * U64(0xD6E8FEB86659FD93) + words[at + j]
    return mix(out), doc[at], at


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is many times faster here than np.unique's hashing)."""
    x = np.sort(values)
    return x[np.flatnonzero(np.append(True, x[1:] != x[:-1]))] if len(x) else x


def distinct_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(values)
    if not len(x):
        return x, np.zeros(0, np.int64)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[at], np.diff(np.append(at, len(x)))


def char_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return lead[offsets[1:]] - lead[offsets[:-1]]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of `values` between consecutive offsets (empty ranges give 0)."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")
