"""Table statistics and checksums.

Every statistic is an aggregate or a sort that Spark distributes; nothing collects a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import checkpointed

#: A hash of a value and a salt.
Hash = Callable[[Column, Column], Column]


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Equi-depth histogram: (bucket, lower, upper, rows, repeats, cumulative).

    Rows are counted by value first; a value lies in one bucket, which is that of its last row if
    rows were cut into `buckets` even parts.  `repeats` counts rows equal to the upper bound.
    Running totals over the distinct values are taken by parts of a range partitioning, so no
    task sees them all.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    placed = running_total(counts, "v", "n")
    total = placed.agg(F.max("upto").alias("total"))
    cut = placed.crossJoin(F.broadcast(total)).withColumn("bucket", F.ceil(F.col("upto") * buckets / F.col("total")).cast("int"))  # one row
    out = cut.groupBy("bucket").agg(F.min("v").alias("lower"), F.max("v").alias("upper"), F.sum("n").alias("rows"), F.max_by("n", "v").alias("repeats"), F.max("upto").alias("cumulative"))
    return out.select("bucket", "lower", "upper", "rows", "repeats", "cumulative")


def running_total(df: DataFrame, key: str, amount: str, out: str = "upto") -> DataFrame:
    """Running sum of `amount` in order of a distinct `key`: within range partitions, plus the totals of those before.

    The rows are written with their partition's number, which another run of the plan could deal differently.
    """
    own = checkpointed(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()))
    inside = own.withColumn("__inside", F.sum(amount).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each non-empty part, ordered by its least key
    parts = own.groupBy("__part").agg(F.min(key).alias("__low"), F.sum(amount).alias("__sum"))
    before = parts.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return inside.join(F.broadcast(before), "__part").withColumn(out, F.col("__inside") + F.col("__before")).drop("__part", "__inside", "__before")


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, rows, nulls, distinct, bytes): exact counts of each column, in one aggregation."""
    aggs: list[Column] = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}"), F.count_distinct(F.col(c)).alias(f"d{i}"), F.sum(F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long")).alias(f"b{i}")]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows"), F.coalesce(f"n{i}", F.lit(0)).alias("nulls"), F.col(f"d{i}").alias("distinct"), F.coalesce(f"b{i}", F.lit(0)).alias("bytes")) for i, c in enumerate(columns)))).alias("s")).select("s.*")


def group_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, nulls, distinct) of a group of columns; a tuple is null if all its columns are."""
    every = F.lit(True)
    for c in columns:
        every = every & F.col(c).isNull()
    return df.agg(F.count("*").alias("rows"), F.sum(every.cast("long")).alias("nulls"), F.count_distinct(F.struct(*columns)).alias("distinct"))


def approximate_distinct(df: DataFrame, column: str, error: float = 0.02) -> DataFrame:
    """(column_name, distinct) by HyperLogLog."""
    return df.agg(F.lit(column).alias("column_name"), F.approx_count_distinct(column, error).alias("distinct"))


def fast_hash(value: Column, salt: Column) -> Column:
    """64 bits of a value and a salt."""
    return F.xxhash64(value, salt)


def portable_hash(value: Column, salt: Column) -> Column:
    """60 bits of MD5 over the value's text, a colon and the salt: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(value.cast("string"), F.lit(":"), salt.cast("string")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def frequency_sketch(df: DataFrame, column: str, depth: int = 5, width: int = 2048, hashed: Hash = fast_hash) -> DataFrame:
    """Count-min sketch as a table (row, slot, n): mergeable by adding; `estimate` reads it.

    Rows are counted by slot where they are, so a task holds and sends `depth` times `width` counts at most.
    """
    slots = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(hashed(F.col(column), F.lit(r)), F.lit(width)).alias("slot")) for r in range(depth)))
    return df.where(F.col(column).isNotNull()).select(F.explode(slots).alias("s")).groupBy("s.row", "s.slot").agg(F.count("*").alias("n"))


def estimate(sketch: DataFrame, value: Column, depth: int = 5, width: int = 2048, hashed: Hash = fast_hash) -> DataFrame:
    """The sketch's upper bound for how often `value` occurs."""
    want = sketch.sparkSession.range(depth).select(F.col("id").cast("int").alias("row"), F.pmod(hashed(value, F.col("id").cast("int")), F.lit(width)).alias("slot"))
    return F.broadcast(want).join(sketch, ["row", "slot"], "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))  # `depth` rows


def distinct_sketch(df: DataFrame, column: str, most: int = 1024, hashed: Hash = fast_hash) -> DataFrame:
    """Distinct sampling: the finest level at which at most `most` hashes end in that many zero bits, and the estimate.

    Each task keeps at most `most` hashes, of its own finest level; the levels of all are merged.
    """
    own = df.where(F.col(column).isNotNull()).select(hashed(F.col(column), F.lit(0)).alias("h"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, level = np.zeros(0, np.int64), 0
        for batch in batches:
            x = batch.column("h").to_numpy()
            held = np.unique(np.concatenate([held, x[x & ((1 << level) - 1) == 0]]))
            while len(held) > most:
                level += 1
                held = held[held & ((1 << level) - 1) == 0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), level, np.int32))], ["h", "level"])

    kept = checkpointed(own.mapInArrow(keep, "h long, level int"))
    zeros = F.length(F.regexp_extract(F.lpad(F.bin("h"), 64, "0"), "(0*)$", 1))
    least = kept.agg(F.coalesce(F.max("level"), F.lit(0)).alias("least"))
    levels = kept.select("h", zeros.alias("z")).crossJoin(F.broadcast(least)).where("z >= least").select("h", "z").distinct().groupBy("z").agg(F.count("*").alias("n"))  # at most 65 rows
    reach = levels.withColumn("n", F.sum("n").over(Window.orderBy(F.desc("z"))))
    level = reach.where(F.col("n") <= most).agg(F.min("z").alias("level"), F.max("n").alias("kept"))
    return level.select(F.coalesce("level", F.lit(0)).alias("level"), (F.coalesce("kept", F.lit(0)) * F.pow(F.lit(2.0), F.coalesce("level", F.lit(0)))).cast("long").alias("distinct"))


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values (ties by value)."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(n)


def reservoir(df: DataFrame, n: int, key: str, seed: int = 0, hashed: Hash = fast_hash) -> DataFrame:
    """n rows, each set as likely as any: those of the least seeded hash of the key, so reruns agree."""
    return df.orderBy(hashed(F.col(key), F.lit(seed)), key).limit(n)


def bernoulli(df: DataFrame, rate: float, key: str, seed: int = 0, hashed: Hash = fast_hash) -> DataFrame:
    """Each row with probability `rate`, decided by a seeded hash of the key."""
    return df.where(F.pmod(hashed(F.col(key), F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def column_sample(df: DataFrame, columns: Sequence[str], n: int, key: str, hashed: Hash = fast_hash) -> DataFrame:
    """(column_name, rows, nulls, samples) of each column: its counts and the texts of up to `n` values, those of rows of least hash."""
    chosen = reservoir(df.select(key, *(c for c in columns if c != key)), n, key, 0, hashed)
    pairs = lambda: F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")
    samples = chosen.select(pairs()).select("p.*").groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("samples"))  # of `n` rows
    counts = df.select(pairs()).select("p.*").groupBy("column_name").agg(F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"))
    return counts.join(F.broadcast(samples), "column_name", "left")


def analyze(df: DataFrame, kind: str, columns: Sequence[str], **options) -> DataFrame:
    """One call for each kind of statistics: `index` and `column` give equi-depth histograms, `common_handle`
    and `full_sampling` counts of columns, `sample` a sample of columns, `mixed` counts of their groups,
    `sketch` a frequency sketch."""
    kinds = {
        "index": lambda: histogram(df, columns[0], **options), "column": lambda: histogram(df, columns[0], **options), "common_handle": lambda: column_statistics(df, columns, **options),
        "full_sampling": lambda: column_statistics(df, columns, **options), "sample": lambda: column_sample(df, columns, **options), "mixed": lambda: group_statistics(df, columns, **options), "sketch": lambda: frequency_sketch(df, columns[0], **options),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind of statistics: {kind}; known are {', '.join(kinds)}")
    return kinds[kind]()


def _crc64_table() -> np.ndarray:
    """Of the reflected polynomial of ECMA-182, from its rule."""
    table = np.zeros(256, np.uint64)
    for i in range(256):
        x = i
        for _ in range(8):
            x = x >> 1 ^ (0xC96C5795D7870F42 if x & 1 else 0)
        table[i] = x
    return table


_CRC64 = _crc64_table()


def _crc64_of(values: pd.Series) -> pd.Series:
    """CRC-64 of each byte string; all strings of a batch advance together, the longest first."""
    data = [b"" if v is None else bytes(v) for v in values]
    size = np.array([len(d) for d in data])
    order = np.argsort(-size, kind="stable")
    raw = np.frombuffer(b"".join(data), np.uint8)
    start = np.append(0, np.cumsum(size))[:-1][order] if len(data) else size
    state = np.full(len(data), 0xFFFFFFFFFFFFFFFF, np.uint64)
    sizes = size[order]
    for p in range(int(size.max()) if len(data) else 0):
        live = int(np.searchsorted(-sizes, -p, side="left"))
        own = state[:live]
        state[:live] = own >> np.uint64(8) ^ _CRC64[((own ^ raw[start[:live] + p]) & np.uint64(255)).astype(np.int64)]
    out = np.empty(len(data), np.uint64)
    out[order] = state ^ np.uint64(0xFFFFFFFFFFFFFFFF)
    return pd.Series(out.view(np.int64))


def crc64(c: Column) -> Column:
    """CRC-64 (ECMA-182, reflected) of bytes, as a signed number."""
    return F.pandas_udf(_crc64_of, "bigint")(c.cast("binary"))


def checksum64(df: DataFrame, key: str, value: str) -> DataFrame:
    """(checksum, total_rows, total_bytes): XOR of the CRC-64 of each key with its value, whatever their order."""
    both = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"), F.coalesce(F.col(value).cast("string"), F.lit("")).cast("binary"))
    return df.agg(F.coalesce(F.bit_xor(crc64(both)), F.lit(0)).alias("checksum"), F.count("*").alias("total_rows"), F.coalesce(F.sum(F.octet_length(both).cast("long")), F.lit(0)).alias("total_bytes"))


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(checksum, total_rows, total_bytes), independent of row order: XOR of a hash of each row."""
    text = F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns))
    return df.agg(F.coalesce(F.bit_xor(F.crc32(text)), F.lit(0)).alias("checksum"), F.count("*").alias("total_rows"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("total_bytes"))
