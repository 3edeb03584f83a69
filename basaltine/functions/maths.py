"""Mathematical functions: results that aren't finite are null where the domain ends, errors where the range does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def _checked(c: Column, name: str) -> Column:
    return F.when(F.abs(c) == float("inf"), F.raise_error(F.lit(f"DOUBLE value is out of range in {name}")).cast("double")).when(~F.isnan(c), c)


def abs_(c: Column) -> Column:
    return F.abs(c)


def ceil(c: Column) -> Column:
    return F.ceil(c)


def floor(c: Column) -> Column:
    return F.floor(c)


def ceil_real(c: Column) -> Column:
    return F.ceil(c).cast("double")


def floor_real(c: Column) -> Column:
    return F.floor(c).cast("double")


def pi() -> Column:
    return F.pi()


def crc32(c: Column) -> Column:
    return F.crc32(c.cast("binary"))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def log(base: Column, c: Column) -> Column:
    return F.when((base > 0) & (base != 1) & (c > 0), F.ln(c) / F.ln(base))


def log2(c: Column) -> Column:
    return F.when(c > 0, F.log2(c))


def log10(c: Column) -> Column:
    return F.when(c > 0, F.log10(c))


def sin(c: Column) -> Column:
    return F.sin(c)


def cos(c: Column) -> Column:
    return F.cos(c)


def tan(c: Column) -> Column:
    return F.tan(c)


def cot(c: Column) -> Column:
    return _checked(F.cot(c), "cot")


def asin(c: Column) -> Column:
    return F.when(c.between(-1, 1), F.asin(c))


def acos(c: Column) -> Column:
    return F.when(c.between(-1, 1), F.acos(c))


def atan(c: Column) -> Column:
    return F.atan(c)


def atan2(a: Column, b: Column) -> Column:
    return F.atan2(a, b)


def pow_(a: Column, b: Column) -> Column:
    return _checked(F.pow(a, b), "pow")


def exp(c: Column) -> Column:
    return _checked(F.exp(c), "exp")


def degrees(c: Column) -> Column:
    return _checked(F.degrees(c), "degrees")


def radians(c: Column) -> Column:
    return F.radians(c)


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def sign(c: Column) -> Column:
    return F.signum(c).cast("bigint")


def round_(c: Column, d: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c, d)


def truncate_int(c: Column, d: int) -> Column:
    if d >= 0:
        return c
    if d <= -19:
        return F.lit(0).cast("bigint")
    return (F.call_function("div", c.cast("bigint"), F.lit(10**-d).cast("bigint")) * F.lit(10**-d)).cast("bigint")


def truncate_real(c: Column, d: int) -> Column:
    scaled = c * F.lit(float(10.0**d))
    return F.when(c.isNull(), None).otherwise(F.when(c >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)).cast("double") / F.lit(float(10.0**d)))


def truncate_decimal(c: Column, d: int) -> Column:
    return F.when(c >= 0, F.floor(c, F.lit(d))).otherwise(F.ceil(c, F.lit(d)))


def conv(c: Column, frm: int, to: int) -> Column:
    """Between bases 2 to 36 (a negative base is signed); other bases give null, text without digits '0'."""
    if not (2 <= abs(frm) <= 36 and 2 <= abs(to) <= 36):
        return F.lit(None).cast("string")
    got = F.conv(F.trim(c), abs(frm), to)
    return F.when(c.isNotNull(), F.coalesce(got, F.lit("0")))


def rand() -> Column:
    return F.rand()


#: Fixed constants of the seeded generator.
_MODULUS, _FACTOR_1, _FACTOR_2, _SECOND_FACTOR = 0x3FFFFFFF, 0x10001, 55555555, 0x10000001


def rand_seeded(seed: Column) -> Column:
    """The first draw of a generator seeded by each row; a null seed counts as 0."""
    s = F.coalesce(seed.cast("bigint"), F.lit(0).cast("bigint"))
    wrap = lambda c: F.pmod(c, F.lit(1 << 32).cast("bigint"))  # noqa: E731  32-bit arithmetic
    one = wrap(s * F.lit(_FACTOR_1) + F.lit(_FACTOR_2)) % F.lit(_MODULUS)
    two = wrap(s * F.lit(_SECOND_FACTOR)) % F.lit(_MODULUS)
    drawn = (one * F.lit(3) + two) % F.lit(_MODULUS)
    return drawn.cast("double") / F.lit(float(_MODULUS))
