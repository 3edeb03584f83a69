"""Distances of float vectors, in double, as expressions; vectors of different length are an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(a: Column, b: Column, f) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors have different dimensions")).cast("double")).otherwise(total)


def _number(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def l1_distance(a: Column, b: Column) -> Column:
    return _number(_pairs(a, b, lambda x, y: F.abs(x - y)))


def l2_distance(a: Column, b: Column) -> Column:
    return _number(F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y))))


def inner_product(a: Column, b: Column) -> Column:
    return _number(_pairs(a, b, lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def l2_norm(v: Column) -> Column:
    return _number(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    scale = l2_norm(a) * l2_norm(b)
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / F.nullif(scale, F.lit(0.0)))) * F.when(scale != 0, 1.0)


def dims(v: Column) -> Column:
    return F.size(v).cast("bigint")


def as_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ","), F.lit("]"))


def from_text(c: Column) -> Column:
    return F.from_json(c, "array<float>")
