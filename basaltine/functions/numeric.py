"""Arithmetic, comparison, control flow, logic and bits.

Unsigned 64-bit values are decimal(20,0).  Comparisons and logic give BIGINT 0/1 or null.
Overflow is an error (ANSI arithmetic); division by zero is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bounds of 64-bit integers.
INT_MIN, INT_MAX, UINT_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1
_U = "decimal(20,0)"


def flag(c: Column) -> Column:
    """A condition as BIGINT."""
    return c.cast("int").cast("bigint")


def truthy(c: Column) -> Column:
    return c != 0


def big(n: int, kind: str = "decimal(38,0)") -> Column:
    """A literal beyond 64 bits."""
    return F.lit(str(n)).cast(kind)


def unsigned(c: Column) -> Column:
    """Signed 64 bits read as unsigned."""
    d = c.cast(_U)
    return F.when(c < 0, (d + big(UINT_MAX + 1, "decimal(21,0)")).cast(_U)).otherwise(d)


def _in_range(c: Column, low: int, high: int, what: str) -> Column:
    wide = c.cast("decimal(38,0)")
    bad = (wide < big(low)) | (wide > big(high))
    return F.when(bad, F.raise_error(F.lit(f"{what} value is out of range")).cast("decimal(38,0)")).otherwise(wide)


def as_int(c: Column) -> Column:
    return _in_range(c, INT_MIN, INT_MAX, "BIGINT").cast("bigint")


def as_uint(c: Column) -> Column:
    return _in_range(c, 0, UINT_MAX, "BIGINT UNSIGNED").cast(_U)


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)").cast("decimal(38,0)")


def plus(a: Column, b: Column) -> Column:
    return a + b


def minus(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def plus_uint(a: Column, b: Column) -> Column:
    """Sum with at least one unsigned side."""
    return as_uint(_wide(a) + _wide(b))


def minus_uint(a: Column, b: Column) -> Column:
    return as_uint(_wide(a) - _wide(b))


def multiply_uint(a: Column, b: Column) -> Column:
    """Exact below 2^64: both sides are split so that no part of the product is over 38 digits."""
    x, y = _wide(a), _wide(b)
    half = big(1 << 32, "decimal(11,0)")
    high, low = F.floor(y / half).cast("decimal(11,0)"), F.pmod(y, half).cast("decimal(11,0)")
    upper, lower = (x.cast("decimal(21,0)") * high).cast("decimal(38,0)"), (x.cast("decimal(21,0)") * low).cast("decimal(38,0)")
    # beyond 2^34 the upper part alone is out of range
    bound = big(1 << 34)
    return as_uint(F.greatest(F.least(upper, bound), -bound) * half.cast("decimal(38,0)") + lower)


def divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def int_divide(a: Column, b: Column) -> Column:
    """Truncating division of integers and decimals: both sides become whole by the scale of 15 digits."""
    x, y = (c.cast("decimal(35,15)") for c in (a, b))
    whole = F.call_function("div", x, F.nullif(y, F.lit(0).cast("decimal(35,15)")))
    return whole.cast("bigint")


def _quotient(a: Column, b: Column) -> Column:
    """Truncated quotient of 64-bit integers of either kind as decimal(38,0); null by zero."""
    x, y = _wide(a), F.nullif(_wide(b), big(0))
    rest = x % y
    return ((x - rest) / y).cast("decimal(38,0)")


def int_divide_int(a: Column, b: Column) -> Column:
    return as_int(_quotient(a, b))


def int_divide_uint(a: Column, b: Column) -> Column:
    """With an unsigned side: the result is unsigned, a negative one an error."""
    return as_uint(_quotient(a, b))


def modulo(a: Column, b: Column) -> Column:
    """The sign follows the dividend."""
    return a % F.nullif(b, F.lit(0))


def negate(c: Column) -> Column:
    return -c


# ---------------------------------------------------------------- comparison

def lt(a: Column, b: Column) -> Column:
    return flag(a < b)


def le(a: Column, b: Column) -> Column:
    return flag(a <= b)


def gt(a: Column, b: Column) -> Column:
    return flag(a > b)


def ge(a: Column, b: Column) -> Column:
    return flag(a >= b)


def eq(a: Column, b: Column) -> Column:
    return flag(a == b)


def ne(a: Column, b: Column) -> Column:
    return flag(a != b)


def null_eq(a: Column, b: Column) -> Column:
    return flag(a.eqNullSafe(b))


def _any_null(args: tuple[Column, ...]) -> Column:
    out = args[0].isNull()
    for a in args[1:]:
        out = out | a.isNull()
    return out


def greatest(*args: Column) -> Column:
    """Null if any argument is."""
    return F.when(~_any_null(args), F.greatest(*args))


def least(*args: Column) -> Column:
    return F.when(~_any_null(args), F.least(*args))


def greatest_time(*args: Column) -> Column:
    """Of texts read as timestamps; null if one can't be read."""
    return greatest(*(F.try_to_timestamp(a) for a in args))


def least_time(*args: Column) -> Column:
    return least(*(F.try_to_timestamp(a) for a in args))


def interval(n: Column, *bounds: Column) -> Column:
    """How many of the ascending bounds are at most n; -1 for null."""
    return F.when(n.isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.array(*bounds), lambda x: F.coalesce(x <= n, F.lit(True))))).cast("bigint")


def coalesce(*args: Column) -> Column:
    return F.coalesce(*args)


def in_list(c: Column, *values: object) -> Column:
    return flag(c.isin(*values))


# ---------------------------------------------------------------- control flow

def if_null(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def if_(condition: Column, a: Column, b: Column) -> Column:
    """A null condition takes the second branch."""
    return F.when(condition != 0, a).otherwise(b)


def case_when(*args: Column) -> Column:
    """Condition, value, condition, value, ... and a last value if the number is odd."""
    out = F
    for i in range(0, len(args) - 1, 2):
        out = out.when(args[i] != 0, args[i + 1])
    return out.otherwise(args[-1]) if len(args) % 2 else out


def any_value(*args: Column) -> Column:
    return args[0]


# ---------------------------------------------------------------- logic and bits

def is_null(c: Column) -> Column:
    return flag(c.isNull())


def is_true(c: Column, keep_null: bool = False) -> Column:
    return flag(c != 0) if keep_null else flag(F.coalesce(c != 0, F.lit(False)))


def is_false(c: Column, keep_null: bool = False) -> Column:
    return flag(c == 0) if keep_null else flag(F.coalesce(c == 0, F.lit(False)))


def logical_and(a: Column, b: Column) -> Column:
    return flag((a != 0) & (b != 0))


def logical_or(a: Column, b: Column) -> Column:
    return flag((a != 0) | (b != 0))


def logical_xor(a: Column, b: Column) -> Column:
    return flag((a != 0) != (b != 0))


def logical_not(c: Column) -> Column:
    return flag(c == 0)


def signed_bits(c: Column) -> Column:
    """The 64 bits of a signed or an unsigned value as BIGINT."""
    d = c.cast("decimal(21,0)")
    return F.when(d > big(INT_MAX, "decimal(21,0)"), d - big(UINT_MAX + 1, "decimal(21,0)")).otherwise(d).cast("bigint")


def bit_and(a: Column, b: Column) -> Column:
    """Unsigned, as all bit operators are."""
    return unsigned(signed_bits(a).bitwiseAND(signed_bits(b)))


def bit_or(a: Column, b: Column) -> Column:
    return unsigned(signed_bits(a).bitwiseOR(signed_bits(b)))


def bit_xor(a: Column, b: Column) -> Column:
    return unsigned(signed_bits(a).bitwiseXOR(signed_bits(b)))


def bit_neg(c: Column) -> Column:
    """Unsigned."""
    return unsigned(F.bitwise_not(signed_bits(c)))


def _shifted(name: str, c: Column, n: Column) -> Column:
    none = F.lit(None).cast(_U)
    return F.when(c.isNull() | n.isNull(), none).when(n.between(0, 63), unsigned(F.call_function(name, signed_bits(c), n.cast("int")))).otherwise(F.lit(0).cast(_U))


def left_shift(c: Column, n: Column) -> Column:
    """Counts outside 0..63 give 0."""
    return _shifted("shiftleft", c, n)


def right_shift(c: Column, n: Column) -> Column:
    """Logical."""
    return _shifted("shiftrightunsigned", c, n)


def bit_count(c: Column) -> Column:
    return F.bit_count(signed_bits(c)).cast("bigint")
