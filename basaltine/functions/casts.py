"""Conversions between kinds of values.

Numbers round half away from zero; text gives its leading number, 0 if there is none; numbers out
of range are an error, but in text, where they become the nearest bound.  Dates and times give
numbers as yyyymmddhhmmss and hhmmss, rounded to the target's digits.  JSON values are JSON text, an
enum value is a struct of its position and its name (`enum`).  What can't be a time is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import temporal
from .numeric import INT_MAX, INT_MIN, UINT_MAX, as_int, as_uint, big
from .temporal import _let

_LEADING = r"^\s*([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)"


def real_to_int(c: Column) -> Column:
    return as_int(F.round(c))


def decimal_to_int(c: Column) -> Column:
    return as_int(F.round(c, 0))


def _number(c: Column) -> Column:
    """The leading number of a text as text, 0 if there is none, null for null."""
    return F.coalesce(F.nullif(F.regexp_extract(c, _LEADING, 1), F.lit("")), F.when(c.isNotNull(), F.lit("0")))


def _within(exact: Column, rough: Column, low: int, high: int) -> Column:
    """A number as decimal(38,0) between two bounds; `exact` is null where only `rough` can hold it."""
    held = F.when(rough > float(high), big(high)).when(rough < float(low), big(low)).otherwise(exact.cast("decimal(38,0)"))
    return _let(held, lambda h: F.when(h > big(high), big(high)).when(h < big(low), big(low)).otherwise(h))


def _text_between(c: Column, low: int, high: int) -> Column:
    return _let(_number(c), lambda n: _within(F.round(n.try_cast("decimal(38,10)")), n.cast("double"), low, high))


def text_to_int(c: Column) -> Column:
    return _text_between(c, INT_MIN, INT_MAX).cast("bigint")


def text_to_uint(c: Column) -> Column:
    """Text of a negative number wraps round."""
    return _let(_text_between(c, INT_MIN, UINT_MAX), to_unsigned)


def to_unsigned(c: Column) -> Column:
    """Negative integers wrap round as unsigned 64-bit values do."""
    wide = c.cast("decimal(38,0)")
    return as_uint(F.when(wide < 0, wide + big(1 << 64)).otherwise(wide))


def text_to_real(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, _LEADING, 1), F.lit("")).cast("double"), F.when(c.isNotNull(), F.lit(0.0)))


def text_to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, _LEADING, 1), F.lit("")).cast(f"decimal({precision},{scale})"), F.when(c.isNotNull(), F.lit(0).cast(f"decimal({precision},{scale})")))


def to_real(c: Column) -> Column:
    return c.cast("double")


def to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def to_text(c: Column) -> Column:
    return c.cast("string")


def real_to_text(c: Column) -> Column:
    """Shortest digits, never with an exponent; whole numbers without a point."""
    return _let(c, _real_text)


def _real_text(c: Column) -> Column:
    t = c.cast("string")
    exponent = F.regexp_extract(t, r"E(-?\d+)$", 1).try_cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, r"^-?([0-9.]+)", 1), r"\.0$", ""), r"\.", "")
    sign = F.when(c < 0, "-").otherwise("")
    wide = F.when(exponent < 0, F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)).when(exponent >= F.length(digits) - 1, F.concat(sign, F.rpad(digits, exponent + 1, F.lit("0"))))
    wide = wide.otherwise(F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits))))
    return F.when(exponent.isNull(), F.regexp_replace(t, r"\.0$", "")).otherwise(wide)


def text_to_text(c: Column, length: int = -1) -> Column:
    """At most `length` characters (-1: all)."""
    return c if length < 0 else F.substring(c, 1, length)


# ---------------------------------------------------------------- times

def round_time(c: Column, digits: int = 0) -> Column:
    """A time rounded to `digits` digits of a second, halves up."""
    unit = 10 ** (6 - digits)
    return F.timestamp_micros((F.floor((F.unix_micros(c.cast("timestamp")) + unit // 2) / F.lit(unit).cast("decimal(7,0)")) * unit).cast("bigint"))


def round_duration(d: Column, digits: int = 0) -> Column:
    """A duration rounded to `digits` digits of a second, halves away from zero, within its bounds."""
    return temporal.clamp(d, digits)


def timestamp_to_text(c: Column, digits: int = 0) -> Column:
    return F.date_format(round_time(c, digits), "yyyy-MM-dd HH:mm:ss" + ("." + "S" * digits if digits else ""))


def timestamp_to_int(c: Column) -> Column:
    return F.date_format(round_time(c), "yyyyMMddHHmmss").cast("bigint")


def timestamp_to_decimal(c: Column, digits: int = 6) -> Column:
    return F.date_format(round_time(c, digits), "yyyyMMddHHmmss" + ("." + "S" * digits if digits else "")).cast(f"decimal({14 + digits},{digits})")


def timestamp_to_real(c: Column, digits: int = 6) -> Column:
    return timestamp_to_decimal(c, digits).cast("double")


def timestamp_to_duration(c: Column, digits: int = 6) -> Column:
    """The time of day."""
    t = round_time(c, digits)
    return temporal._interval((F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("bigint") * 1_000_000 + F.pmod(F.unix_micros(t), F.lit(1_000_000)))


def timestamp_to_json(c: Column) -> Column:
    return _quoted(timestamp_to_text(c, 6))


def date_to_int(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("bigint")


def duration_to_decimal(d: Column, digits: int = 6) -> Column:
    def number(t: Column) -> Column:
        size = F.abs(t)
        whole = F.floor(size).cast("bigint")
        parts = F.floor(whole / 3600) * 10000 + F.floor(whole / 60) % 60 * 100 + whole % 60
        return F.signum(t).cast("decimal(1,0)") * (parts.cast("decimal(12,0)") + (size - whole).cast("decimal(6,6)"))

    return _let(temporal._seconds(round_duration(d, digits)), number).cast(f"decimal({8 + digits},{digits})")


def duration_to_int(d: Column) -> Column:
    return duration_to_decimal(d, 0).cast("bigint")


def duration_to_real(d: Column) -> Column:
    return duration_to_decimal(d).cast("double")


def duration_to_timestamp(d: Column, day: Column | None = None, digits: int = 6) -> Column:
    """That much after the start of `day` (the current one)."""
    start = (F.current_date() if day is None else day).cast("timestamp")
    return round_time(start + d, digits)


def duration_to_json(d: Column) -> Column:
    return _quoted(_let(d, lambda x: F.concat(temporal.format_time(x), F.when(temporal.microsecond(x) == 0, ".000000").otherwise(""))))


def _micros_of(digits_text: Column, digits: int) -> Column:
    """Microseconds of the digits after a point, rounded to `digits` digits."""
    return F.coalesce((F.round(F.concat(F.lit("0."), F.substring(digits_text, 1, 12), F.lit("0")).cast("decimal(14,13)"), digits) * 1_000_000).cast("bigint"), F.lit(0).cast("bigint"))


def _plus_micros(whole: Column, micros: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(whole) + micros)


def _parts_time(a: Column, digits: int) -> Column:
    """A time from an array of digits: year, month, day, hour, minute, second, fraction, the later ones left out."""
    n = lambda i: F.coalesce(F.nullif(F.get(a, F.lit(i)), F.lit("")), F.lit("0")).cast("int")
    year = n(0) + F.when(F.length(F.get(a, F.lit(0))) > 2, 0).when(n(0) < 70, 2000).otherwise(1900)
    return _plus_micros(F.try_make_timestamp(year, n(1), n(2), n(3), n(4), F.when(n(5) < 60, n(5)).cast("decimal(16,6)")), _micros_of(F.get(a, F.lit(6)), digits))


#: Date, and time of day if there is one, apart by any punctuation; digits run together, maybe with a fraction.
_APART = r"^\d{1,4}[^\w\s]\d{1,2}[^\w\s]\d{1,2}(?:(?:T|\s+)\d{1,2}(?:[^\w\s]\d{1,2}(?:[^\w\s]\d{1,2}(?:\.\d*)?)?)?)?$"
_RUN = r"^\d{6,14}(?:\.\d*)?$"


def text_to_timestamp(c: Column, digits: int = 6) -> Column:
    """Year, month and day, and hours, minutes and seconds if there are any, apart by any punctuation
    (date and time by blanks or T), or run together in 6, 8, 10, 12 or 14 digits; a fraction is rounded.
    Years of two digits are 1970 to 2069."""
    return _let(F.trim(c), lambda t: F.when(t.rlike(_APART), _let(F.split(t, r"\D+"), lambda a: _parts_time(a, digits))).when(t.rlike(_RUN), _let(F.split(t, r"\."), lambda a: _run_time(a, digits))))


def _run_time(a: Column, digits: int) -> Column:
    d, tail = F.get(a, F.lit(0)), F.get(a, F.lit(1))
    size = F.length(d)
    four = lambda first: F.array(F.substring(d, 1, first), *(F.substring(d, i, 2) for i in range(first + 1, first + 10, 2)), F.coalesce(tail, F.lit("")))
    return F.when(size.isin(8, 14), _let(four(4), lambda x: _parts_time(x, digits))).when(size.isin(6, 10, 12), _let(four(2), lambda x: _parts_time(x, digits)))


#: Fixed bounds of dates written as numbers: what is under a bound gets what follows (None: isn't a date).
_NUMBER_RULES = (
    (101, None), (691_232, 20_000_000), (700_101, None), (991_232, 19_000_000), (10_000_101, None), (99_991_232, 0),
    (101_000_000, None), (691_231_240_000, 20_000_000_000_000), (700_101_000_000, None), (991_231_240_000, 19_000_000_000_000), (10_000_101_000_000, None),
)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def int_to_timestamp(c: Column) -> Column:
    """A number as yymmdd, yyyymmdd, yymmddhhmmss or yyyymmddhhmmss, with leading zeros left out; null if it isn't one."""

    def full(n: Column) -> Column:
        out = F.when(n.isNull(), F.lit(None).cast("bigint"))
        for bound, more in _NUMBER_RULES:
            out = out.when(n < bound, F.lit(None).cast("bigint") if more is None else (n + more) * (1_000_000 if bound <= 99_991_232 else 1))
        return out.when(n <= 99_991_231_235_959, n)

    def moment(n: Column) -> Column:
        two = lambda unit: (_div(n, unit) % 100).cast("int")
        return F.try_make_timestamp(_div(n, 10**10).cast("int"), two(10**8), two(10**6), two(10**4), two(100), F.when(n % 100 < 60, n % 100).cast("decimal(16,6)"))

    return _let(_let(c.cast("bigint"), full), moment)


def decimal_to_timestamp(c: Column, digits: int = 6) -> Column:
    """As of its whole part; the fraction, if the whole part has a time of day, is that of the second."""

    def moment(wide: Column) -> Column:
        whole = F.floor(wide).cast("bigint")
        micros = (F.round(wide - whole, digits) * 1_000_000).cast("bigint")
        return _plus_micros(int_to_timestamp(whole), F.when(whole > 99_991_231, micros).otherwise(F.lit(0).cast("bigint")))

    return _let(c.cast("decimal(38,12)"), moment)


def real_to_timestamp(c: Column, digits: int = 6) -> Column:
    return decimal_to_timestamp(c.try_cast("decimal(38,12)"), digits)


def text_to_duration(c: Column, digits: int = 6) -> Column:
    return round_duration(_let(c, temporal.parse_time), digits)


def decimal_to_duration(c: Column, digits: int = 6) -> Column:
    """hhmmss.ffffff; null beyond 8385959.999999, or with over 59 minutes or seconds."""

    def interval(x: Column) -> Column:
        size = F.abs(x)
        n = F.floor(size).cast("bigint")
        seconds = (_div(n, 10_000) * 3600 + _div(n, 100) % 100 * 60 + n % 100).cast("decimal(18,6)") + F.round(size - n, digits).cast("decimal(18,6)")
        good = (size < 8_385_960) & (_div(n, 100) % 100 < 60) & (n % 100 < 60)
        return F.when(good, F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.signum(x).cast("decimal(1,0)") * seconds).cast("decimal(18,6)")))

    return temporal.clamp(_let(c.cast("decimal(38,12)"), interval))


def int_to_duration(c: Column) -> Column:
    """hhmmss; 10 digits and more are a date and time, whose time of day it is; other values beyond 8385959 are null."""
    n = c.cast("bigint")
    return F.when(n >= 10_000_000_000, _let(int_to_timestamp(n), lambda t: timestamp_to_duration(t))).otherwise(decimal_to_duration(n))


def real_to_duration(c: Column, digits: int = 6) -> Column:
    return decimal_to_duration(c.try_cast("decimal(38,12)"), digits)


# ---------------------------------------------------------------- JSON

def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _json_text(c: Column) -> Column:
    """What a JSON string holds."""
    return F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")


def _of_json(c: Column, text, number, one: Column, zero: Column) -> Column:
    """By kind of value: strings, numbers, true; false, null, arrays and objects are zero."""
    return _let(F.trim(c), lambda t: F.when(t.startswith('"'), text(_json_text(t))).when(t.rlike(r"^-?[0-9]"), number(t)).when(t == "true", one).when(t.isNotNull(), zero))


def json_to_int(c: Column) -> Column:
    """Fractions are rounded."""
    return _of_json(c, text_to_int, text_to_int, F.lit(1).cast("bigint"), F.lit(0).cast("bigint"))


def json_to_uint(c: Column) -> Column:
    return _of_json(c, text_to_uint, text_to_uint, F.lit(1).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def json_to_real(c: Column) -> Column:
    return _of_json(c, text_to_real, text_to_real, F.lit(1.0), F.lit(0.0))


def json_to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    kind = f"decimal({precision},{scale})"
    return _of_json(c, lambda t: text_to_decimal(t, precision, scale), lambda t: text_to_decimal(t, precision, scale), F.lit(1).cast(kind), F.lit(0).cast(kind))


def json_to_text(c: Column) -> Column:
    """JSON text: strings keep their quotes."""
    return c


def json_to_timestamp(c: Column, digits: int = 6) -> Column:
    """Strings only; other kinds are null."""
    return F.when(F.trim(c).startswith('"'), text_to_timestamp(_json_text(F.trim(c)), digits))


def json_to_duration(c: Column, digits: int = 6) -> Column:
    """Strings only; other kinds are null."""
    return F.when(F.trim(c).startswith('"'), text_to_duration(_json_text(F.trim(c)), digits))


# ---------------------------------------------------------------- enum

def enum(value: Column, names: list[str]) -> Column:
    """The value of an enum by its position from 1; 0 is the empty value without a name."""
    name = F.when(value == 0, F.lit("")).otherwise(F.try_element_at(F.array(*map(F.lit, names)), F.nullif(value, F.lit(0)).cast("int")))
    return F.when(name.isNotNull(), F.struct(value.cast("bigint").alias("value"), name.alias("name")))


def enum_to_int(c: Column) -> Column:
    return c["value"]


def enum_to_real(c: Column) -> Column:
    return c["value"].cast("double")


def enum_to_decimal(c: Column, precision: int = 38, scale: int = 10) -> Column:
    return c["value"].cast(f"decimal({precision},{scale})")


def enum_to_text(c: Column) -> Column:
    return c["name"]


def enum_to_timestamp(c: Column, digits: int = 6) -> Column:
    return text_to_timestamp(c["name"], digits)


def enum_to_duration(c: Column, digits: int = 6) -> Column:
    return text_to_duration(c["name"], digits)


def enum_to_json(c: Column) -> Column:
    return to_json(c["name"])


def int_to_year(c: Column) -> Column:
    """0 to 69 are 20xx (0 stays), 70 to 99 are 19xx; 1901 to 2155 stay; others are null."""
    return F.when(c == 0, 0).when(c.between(1, 69), c + 2000).when(c.between(70, 99), c + 1900).when(c.between(1901, 2155), c).cast("bigint")


def to_json(c: Column) -> Column:
    """A number, boolean or quoted text as JSON text."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")


def encode(c: Column, charset: str = "utf-8", errors: str = "strict") -> Column:
    """Text to bytes; charsets that Spark lacks go through Python's codecs, which `errors` tells what to do with other characters."""
    if charset.lower() in ("gbk", "gb18030"):
        return F.pandas_udf(lambda s: s.map(lambda t: t.encode(charset, errors), na_action="ignore"), "binary")(c)
    return F.encode(c, charset)


def decode(c: Column, charset: str = "utf-8") -> Column:
    """Bytes to text; invalid bytes are an error."""
    if charset.lower() in ("gbk", "gb18030"):
        return F.pandas_udf(lambda s: s.map(lambda b: bytes(b).decode(charset), na_action="ignore"), "string")(c)
    return F.decode(c, charset)
