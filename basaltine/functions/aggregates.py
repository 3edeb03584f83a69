"""Aggregates with mergeable partial states, as the push-down side computes them and as a final stage merges them.

Nulls are ignored but by FIRST.  Integers are summed as decimals.  Bit aggregates give their
neutral element on empty input, and read as signed 64-bit integers (all ones is -1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def summable(c: Column, kind: str) -> Column:
    """The argument of SUM, AVG and VARIANCE: integers and decimals as decimal(38, s), everything else as double."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("decimal(38,0)")
    return c if kind.startswith("decimal") else c.cast("double")


def count(c: Column | None = None) -> Column:
    return F.count("*" if c is None else c)


def sum_(c: Column, kind: str = "double") -> Column:
    return F.sum(summable(c, kind))


def avg_partial(c: Column, kind: str = "double", name: str = "avg") -> list[Column]:
    """Count and sum, the partial state of AVG."""
    return [F.count(c).alias(f"{name}_count"), F.sum(summable(c, kind)).alias(f"{name}_sum")]


def avg_merge(name: str = "avg", kind: str = "double") -> Column:
    """AVG of merged partial states: of integers and decimals an exact decimal with four more digits, of others a double."""
    total, n = F.sum(f"{name}_sum"), F.nullif(F.sum(f"{name}_count"), F.lit(0))
    if kind.startswith("decimal") or kind in ("tinyint", "smallint", "int", "bigint"):
        scale = int(kind.rstrip(")").split(",")[1]) if "," in kind else 0
        return F.round(total.cast(f"decimal(38,{min(scale + 6, 18)})") / n.cast("decimal(20,0)"), min(scale + 4, 30)).cast(f"decimal(38,{min(scale + 4, 30)})")
    return total.cast("double") / n


def minimum(c: Column) -> Column:
    return F.min(c)


def maximum(c: Column) -> Column:
    return F.max(c)


def first(c: Column, by: Column) -> Column:
    """The value of the first row by `by`, null included (without an order, a first row isn't defined)."""
    return F.min_by(F.struct(c.alias("v")), by)["v"]


def bit_and(c: Column) -> Column:
    return F.coalesce(F.bit_and(c.cast("bigint")), F.lit(-1).cast("bigint"))


def bit_or(c: Column) -> Column:
    return F.coalesce(F.bit_or(c.cast("bigint")), F.lit(0).cast("bigint"))


def bit_xor(c: Column) -> Column:
    return F.coalesce(F.bit_xor(c.cast("bigint")), F.lit(0).cast("bigint"))


def variance_partial(c: Column, name: str = "var") -> list[Column]:
    """Count, sum and population variance: the partial state of the variances."""
    x = c.cast("double")
    return [F.count(x).alias(f"{name}_count"), F.sum(x).alias(f"{name}_sum"), F.var_pop(x).alias(f"{name}_pop")]


def variance_merge(name: str = "var", sample: bool = False) -> Column:
    """Variance of merged states: the squares within them, and those of their means around the mean of all.

    Means and counts are merged one after the other (each state moves the mean by its share), so no
    two large sums of squares are subtracted.  The states of a group, one for each partition, are
    gathered in one array.
    """
    n, s, v = (F.col(f"{name}_{x}").cast("double") for x in ("count", "sum", "pop"))
    states = F.collect_list(F.when(n > 0, F.struct(n.alias("n"), (s / n).alias("mean"), (n * v).alias("squares"))))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def step(a: Column, b: Column) -> Column:
        both, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(both.alias("n"), (a["mean"] + apart * b["n"] / both).alias("mean"), (a["squares"] + b["squares"] + apart * apart * a["n"] * b["n"] / both).alias("squares"))

    return F.aggregate(states, start, step, lambda t: F.when(t["n"] > (1 if sample else 0), t["squares"] / (t["n"] - (1 if sample else 0))))


def var_pop(c: Column) -> Column:
    return F.var_pop(c)


def var_samp(c: Column) -> Column:
    """Null for fewer than two values."""
    return F.when(F.count(c) > 1, F.var_samp(c))
