"""Multi-version tables: rows (key, commit_ts, op, value) read as of a time, or by what changed between two.

`op` is put or delete.  Reads never sort globally: the latest version of each key is an aggregate
that combines before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_versions(log: DataFrame, upto: int | None = None, after: int | None = None) -> DataFrame:
    """For each key its last version with after < commit_ts <= upto, deletes included."""
    own = log
    if upto is not None:
        own = own.where(F.col("commit_ts") <= upto)
    if after is not None:
        own = own.where(F.col("commit_ts") > after)
    rest = [c for c in log.columns if c not in ("key", "commit_ts")]
    newest = F.max_by(F.struct("commit_ts", *rest), "commit_ts").alias("v")
    return own.groupBy("key").agg(newest).select("key", "v.*")


def as_of(log: DataFrame, ts: int) -> DataFrame:
    """(key, value) visible at `ts`: the latest put of each key that no later delete hides."""
    return latest_versions(log, upto=ts).where("op = 'put'").select("key", "value")


def point_get(log: DataFrame, key: object, ts: int) -> DataFrame:
    return as_of(log.where(F.col("key") == F.lit(key)), ts)


def batch_get(log: DataFrame, keys: Sequence[object], ts: int) -> DataFrame:
    return as_of(log.where(F.col("key").isin(list(keys))), ts)


def scan(log: DataFrame, ts: int, low: object = None, high: object = None, limit: int | None = None, desc: bool = False) -> DataFrame:
    """Visible rows with low <= key < high in key order."""
    own = log
    if low is not None:
        own = own.where(F.col("key") >= F.lit(low))
    if high is not None:
        own = own.where(F.col("key") < F.lit(high))
    out = as_of(own, ts).orderBy(F.col("key").desc() if desc else F.col("key").asc())
    return out if limit is None else out.limit(limit)


def deltas(log: DataFrame, after: int, upto: int) -> DataFrame:
    """Every version with after < commit_ts <= upto."""
    return log.where((F.col("commit_ts") > after) & (F.col("commit_ts") <= upto))


def with_old_value(log: DataFrame) -> DataFrame:
    """Each version with the value before it (null if there was none, or it was deleted)."""
    before = Window.partitionBy("key").orderBy("commit_ts")
    return log.withColumn("old_value", F.when(F.lag("op").over(before) == "put", F.lag("value").over(before)))


def garbage(log: DataFrame, safe_point: int) -> DataFrame:
    """Versions that no read at or after the safe point can see."""
    later = Window.partitionBy("key").orderBy("commit_ts")
    nxt = F.lead("commit_ts").over(later)
    hidden = (nxt <= safe_point) | (nxt.isNull() & (F.col("op") == "delete") & (F.col("commit_ts") <= safe_point))
    return log.withColumn("__hidden", F.coalesce(hidden, F.lit(False))).where("__hidden").drop("__hidden")


def alive(table: DataFrame, now: Column | int, expiry: str = "expire_ts") -> DataFrame:
    """Raw key-value rows that haven't expired; a null or zero expiry never does."""
    e = F.col(expiry)
    return table.where(e.isNull() | (e == 0) | (e > (F.lit(now) if isinstance(now, int) else now)))


def ttl(table: DataFrame, keys: Sequence[object], now: int, expiry: str = "expire_ts") -> DataFrame:
    """(key, ttl) of the living ones among `keys`: what is left until they expire, null if they never do."""
    own = alive(table.where(F.col("key").isin(list(keys))), now, expiry)
    return own.select("key", (F.nullif(F.col(expiry), F.lit(0)) - now).alias("ttl"))


def batch_scan(table: DataFrame, ranges: Sequence[tuple[object, object]], each: int | None = None) -> DataFrame:
    """Rows of several ranges (low <= key < high), each of them in key order with at most `each` rows."""
    out = None
    for low, high in ranges:
        own = table.where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))
        own = own if each is None else own.orderBy("key").limit(each)
        out = own if out is None else out.unionByName(own)
    return table.limit(0) if out is None else out


def write_batch(table: DataFrame, edits: DataFrame) -> DataFrame:
    """The table after a batch of edits (key, op, value, place) that take effect as one; of a key's edits the last counts."""
    last = edits.groupBy("key").agg(F.max_by(F.struct("op", "value"), "place").alias("e")).select("key", "e.op", "e.value")
    return table.join(last.select("key"), "key", "left_anti").unionByName(last.where("op = 'put'").select("key", "value"))


def put(table: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """`rows` over `table`: keys of both keep the new row."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def delete_range(table: DataFrame, low: object, high: object, key: str = "key") -> DataFrame:
    return table.where(~((F.col(key) >= F.lit(low)) & (F.col(key) < F.lit(high))))


def compare_and_swap(table: DataFrame, key: object, expected: object | None, value: object) -> DataFrame:
    """The table with `key` set to `value` if its value is `expected` (None: absent), else unchanged."""
    spark = table.sparkSession
    own = table.where(F.col("key") == F.lit(key))
    found = own.select("value").limit(1).collect()  # one key
    now = found[0]["value"] if found else None
    if now != expected:
        return table
    return put(table, spark.createDataFrame([(key, value)], table.select("key", "value").schema))


def export(log: DataFrame, path: str, upto: int, after: int | None = None, partitions: int | None = None) -> None:
    """Write a snapshot (or, with `after`, the latest change of each key since) as Parquet in key ranges."""
    out = as_of(log, upto) if after is None else latest_versions(log, upto, after)
    (out.repartitionByRange(partitions, "key") if partitions else out).sortWithinPartitions("key").write.mode("errorifexists").parquet(path)
