"""Strings under a collation: keys that compare, group and sort as the collation says.

The Chinese collations without case compare the upper-case text's bytes in their charset, whose order
is by sound for the common characters only; characters that the charset lacks compare as `?`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import casts

#: Collations by name: Spark's collation, or none for bytes, and whether trailing spaces count.
COLLATIONS = {
    "binary": (None, True), "utf8mb4_bin": (None, False), "utf8mb4_0900_bin": (None, True), "latin1_bin": (None, False),
    "utf8mb4_general_ci": ("UNICODE_CI_AI", False), "utf8mb4_unicode_ci": ("UNICODE_CI_AI", False), "utf8mb4_0900_ai_ci": ("UNICODE_CI_AI", True),
}
#: Collations that compare bytes of another charset, and whether they fold case first.
CHARSETS = {"gbk_bin": ("gbk", False), "gbk_chinese_ci": ("gbk", True), "gb18030_bin": ("gb18030", False), "gb18030_chinese_ci": ("gb18030", True)}


def key(c: Column, collation: str = "utf8mb4_bin", pad: bool | None = None) -> Column:
    """A column whose comparisons follow the collation; `pad` overrides whether trailing spaces count."""
    if collation in CHARSETS:
        charset, folds = CHARSETS[collation]
        own = c if pad else F.rtrim(c)
        return casts.encode(F.upper(own) if folds else own, charset, "replace")
    name, spaces = COLLATIONS[collation]
    out = c if (spaces if pad is None else pad) else F.rtrim(c)
    return out if name is None else F.collate(out, name)


def compare(a: Column, b: Column, collation: str = "utf8mb4_bin") -> Column:
    """-1, 0 or 1; null if either is."""
    x, y = key(a, collation), key(b, collation)
    return F.when(x < y, -1).when(x == y, 0).when(x > y, 1).cast("bigint")


def equal(a: Column, b: Column, collation: str = "utf8mb4_bin") -> Column:
    return (key(a, collation) == key(b, collation)).cast("int").cast("bigint")


def in_list(c: Column, values: list[str], collation: str = "utf8mb4_bin") -> Column:
    own = key(c, collation)
    out = F.lit(False)
    for v in values:
        out = out | (own == key(F.lit(v), collation))
    return out.cast("int").cast("bigint")


def field(c: Column, values: list[str], collation: str = "utf8mb4_bin") -> Column:
    """Position of the first equal value, 0 if there is none."""
    own = key(c, collation)
    out = F.lit(0)
    for i in range(len(values), 0, -1):
        out = F.when(own == key(F.lit(values[i - 1]), collation), i).otherwise(out)
    return out.cast("bigint")
