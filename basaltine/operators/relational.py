"""Scans, filters, projections, aggregations, limits and top-N.

Everything here declares a logical plan: filters and column lists reach the file scan, aggregates
combine before they shuffle, and top-N never sorts more than it keeps.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

#: Bytes of handles that an index look-up broadcasts at most; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class KeyRange:
    """Keys from `low` (inclusive) to `high` (exclusive); None is unbounded.  A point has low == high."""

    low: object = None
    high: object = None

    def condition(self, key: Column) -> Column:
        if self.low is not None and self.low == self.high:
            return key == F.lit(self.low)
        out = F.lit(True)
        if self.low is not None:
            out = out & (key >= F.lit(self.low))
        if self.high is not None:
            out = out & (key < F.lit(self.high))
        return out


def in_ranges(key: Column, ranges: Iterable[KeyRange]) -> Column:
    """Whether the key lies in any of the ranges; no ranges select nothing."""
    points, rest = [], None
    for r in ranges:
        if r.low is not None and r.low == r.high:
            points.append(r.low)
        else:
            rest = r.condition(key) if rest is None else rest | r.condition(key)
    if points:
        found = key.isin(points)
        return found if rest is None else rest | found
    return F.lit(False) if rest is None else rest


def table_scan(table: DataFrame, columns: Sequence[str], key: str | None = None, ranges: Sequence[KeyRange] | None = None, desc: bool = False, ordered: bool = False) -> DataFrame:
    """Columns of the rows whose key is in the ranges; in key order only if asked for (a full sort)."""
    out = table if ranges is None else table.where(in_ranges(F.col(key), ranges))
    if ordered or desc:
        out = out.orderBy(F.col(key).desc() if desc else F.col(key).asc())
    return out.select(*columns)


def index_scan(table: DataFrame, index: Sequence[str], handle: str, ranges: Sequence[KeyRange] | None = None, desc: bool = False, ordered: bool = True, unique: bool = False) -> DataFrame:
    """The index's columns and the handle, in index order; ranges are of the first index column.

    For a unique index, entries whose columns are all non-null are ordered by these alone.
    """
    names = [*index, handle]
    out = table.select(*names) if ranges is None else table.where(in_ranges(F.col(index[0]), ranges)).select(*names)
    if not ordered:
        return out
    keys = index if unique else names
    return out.orderBy(*(F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c in keys))


def index_lookup(index: DataFrame, table: DataFrame, handle: str, columns: Sequence[str], handle_in_table: str | None = None) -> DataFrame:
    """Rows of `table` for the handles of an index scan, one for each index entry.

    Handles are broadcast only if the optimizer's size estimate is under BROADCAST_BYTES; otherwise both sides are shuffled by the handle.
    """
    own = index.select(F.col(handle).alias("__handle"))
    size = int(str(own._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES:
        own = F.broadcast(own)
    return table.join(own, F.col(handle_in_table or handle) == F.col("__handle"), "inner").select(*columns)


def unresolved_handles(index: DataFrame, table: DataFrame, handle: str, handle_in_table: str | None = None) -> DataFrame:
    """Handles of an index scan without a row in `table` (rows that live elsewhere)."""
    own = index.select(handle)
    return own.join(table.select(F.col(handle_in_table or handle).alias(handle)), handle, "left_anti")


def truth(df: DataFrame, condition: Column | str) -> Column:
    """A condition as boolean: numbers by being non-zero, strings by their leading number."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, BooleanType):
        return c
    if isinstance(kind, StringType):
        return F.coalesce(F.try_to_number(F.regexp_extract(c, r"^\s*([-+]?[0-9]+)", 1), F.lit("S999999999999999999")), F.lit(0)) != 0
    if isinstance(kind, NumericType):
        return c != 0
    return c.cast("boolean")


def selection(df: DataFrame, conditions: Sequence[Column | str]) -> DataFrame:
    """Rows for which every condition is true; null is not."""
    for c in conditions:
        df = df.where(truth(df, c))
    return df


def projection(df: DataFrame, expressions: Sequence[Column | str]) -> DataFrame:
    return df.select(*(F.expr(e) if isinstance(e, str) else e for e in expressions))


def simple_aggregation(df: DataFrame, aggregates: Sequence[Column]) -> DataFrame:
    """One row, on empty input too."""
    return df.agg(*aggregates)


def hash_aggregation(df: DataFrame, groups: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """One row for each group; aggregate columns come first, then the groups."""
    named = [F.col(g) if isinstance(g, str) else g for g in groups]
    names = df.select(*named).columns
    out = df.groupBy(*named).agg(*aggregates)
    rest = out.columns[len(names) :]
    return out.select(*rest, *names)


def stream_aggregation(df: DataFrame, groups: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    """As hash_aggregation, with groups in the order of their keys (nulls first)."""
    return hash_aggregation(df, groups, aggregates).orderBy(*(F.col(g).asc_nulls_first() for g in groups))


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)


def ordering(orders: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column or expression, descending) pairs as sort columns; null is lowest."""
    return [F.expr(e).desc_nulls_last() if d else F.expr(e).asc_nulls_first() for e, d in orders]


def top_n(df: DataFrame, orders: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows in order; n = 0 gives none."""
    return df.orderBy(*ordering(orders)).limit(n)


def partition_top_n(df: DataFrame, partitions: Sequence[str], orders: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """The first n rows of each partition; without orders, any n.  Partitions are cut down before they are shuffled."""
    window = Window.partitionBy(*partitions).orderBy(*(ordering(orders) or [F.lit(1)]))
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def partition_limit(df: DataFrame, partitions: Sequence[str], n: int) -> DataFrame:
    return partition_top_n(df, partitions, [], n)


def page(df: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next `size` rows by key after the last key of the page before: a range filter and a top-N, never an offset."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_join(rows: DataFrame, ranges: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows whose value is in a range (low <= value < high), each beside the columns of that range.

    Both sides are cut in bins of `width`, a range lies in every bin that it touches, and only rows and
    ranges of one bin are compared: an equi-join that Spark shuffles, splits if skewed, or broadcasts.
    Null values and empty ranges match nothing.
    """
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    cut = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(bins))
    return rows.withColumn("__bin", F.floor(F.col(value) / width)).join(cut, "__bin").where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("__bin")


def as_of_join(rows: DataFrame, events: DataFrame, key: str, event_key: str, at: str, event_at: str, columns: Sequence[str]) -> DataFrame:
    """Each row beside `columns` of the latest event of its key that isn't after it (null if there is none).

    Both sides go through one window over (key, time), so neither is joined with the other's rows.
    """
    kept = [F.struct(*columns).alias("__event")]
    left = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(events.select(*kept).schema[0].dataType).alias("__event"))
    right = events.select(F.col(event_key).alias("__key"), F.col(event_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), *kept)
    upto = Window.partitionBy("__key").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("__event", F.last("__event", ignorenulls=True).over(upto)).where("__side = 1")
    return found.select("__row.*", "__event.*")
