"""Dates, times and durations.  A duration is a day-to-second interval within 838:59:59; times are UTC timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bound of durations, in seconds.
MOST_SECONDS = 838 * 3600 + 59 * 60 + 59


def _let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(c), with c evaluated once however often fn names it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def _n(c: Column) -> Column:
    return c.cast("bigint")


def date(c: Column) -> Column:
    return F.to_date(c)


def year(c: Column) -> Column:
    return _n(F.year(c))


def month(c: Column) -> Column:
    return _n(F.month(c))


def quarter(c: Column) -> Column:
    return _n(F.quarter(c))


def day_of_month(c: Column) -> Column:
    return _n(F.dayofmonth(c))


def day_of_year(c: Column) -> Column:
    return _n(F.dayofyear(c))


def day_of_week(c: Column) -> Column:
    """1 is Sunday."""
    return _n(F.dayofweek(c))


def weekday(c: Column) -> Column:
    """0 is Monday."""
    return _n(F.weekday(c))


def week_of_year(c: Column) -> Column:
    return _n(F.weekofyear(c))


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def last_day(c: Column) -> Column:
    return F.last_day(c)


def to_days(c: Column) -> Column:
    """Days since year 0."""
    return _n(F.datediff(F.to_date(c), F.lit("0001-01-01").cast("date")) + 366)


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("0001-01-01").cast("date"), (n - 366).cast("int"))


def to_seconds(c: Column) -> Column:
    return to_days(c) * 86400 + _n(F.hour(c)) * 3600 + _n(F.minute(c)) * 60 + _n(F.second(c))


def date_diff(a: Column, b: Column) -> Column:
    return _n(F.datediff(a, b))


def make_date(y: Column, n: Column) -> Column:
    """The n-th day of a year; years 0 to 69 are 20xx, 70 to 99 are 19xx; null outside."""
    full = F.when(y.between(0, 69), y + 2000).when(y.between(70, 99), y + 1900).otherwise(y)
    out = F.date_add(F.make_date(F.when(full.between(0, 9999), full).cast("int"), F.lit(1), F.lit(1)), (n - 1).cast("int"))
    return F.when((n >= 1) & (F.year(out) <= 9999), out)


# ---------------------------------------------------------------- weeks

def _week_and_year(c: Column, mode: int, keep_year: bool) -> tuple[Column, Column]:
    """Week number and its year by MySQL's mode bits: 1 Monday first, 2 weeks 1 to 53, 4 the first week holds the first day."""
    monday = bool(mode & 1)
    by_first_day = bool(mode & 4) != (not monday)  # flipped when weeks begin on Sunday
    year_long = bool(mode & 2) or keep_year
    d = F.to_date(c)
    y = F.year(d)

    def first_day(of: Column) -> Column:
        """Weekday of January 1st: 0 is the first day of the week."""
        jan = F.make_date(of, F.lit(1), F.lit(1))
        return F.weekday(jan) if monday else (F.dayofweek(jan) - 1)

    def start(of: Column) -> Column:
        """Day of year (from 0, maybe negative) on which week 1 begins."""
        w = first_day(of)
        if by_first_day:
            return F.when(w == 0, 0).otherwise(7 - w)
        return F.when(w <= 3, -w).otherwise(7 - w)

    doy = F.dayofyear(d) - 1
    length = lambda of: F.dayofyear(F.make_date(of, F.lit(12), F.lit(31)))
    here = F.floor((doy - start(y)) / 7) + 1
    before = F.floor((doy + length(y - 1) - start(y - 1)) / 7) + 1
    week = F.when(here < 1, before if year_long else F.lit(0)).otherwise(here)
    out_year = F.when(here < 1, y - 1).otherwise(y)
    if year_long:  # the last days may belong to week 1 of the next year
        ahead = (here >= 53) & (doy - length(y) >= start(y + 1))
        week, out_year = F.when(ahead, F.lit(1)).otherwise(week), F.when(ahead, y + 1).otherwise(out_year)
    return _n(week), _n(out_year)


def week(c: Column, mode: int = 0) -> Column:
    return _week_and_year(c, mode & 7, False)[0]


def year_week(c: Column, mode: int = 0) -> Column:
    w, y = _week_and_year(c, (mode & 7) | 2, True)
    return y * 100 + w


# ---------------------------------------------------------------- formats

def date_format(c: Column, layout: str) -> Column:
    """MySQL's specifiers, each as an expression; an unknown letter stands for itself."""
    hour = F.hour(c)
    twelve = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.dayofmonth(c)
    suffix = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    clock = lambda h: F.concat(two(h), F.lit(":"), two(F.minute(c)), F.lit(":"), two(F.second(c)))
    half = F.when(hour < 12, "AM").otherwise("PM")
    table = {
        "b": lambda: F.date_format(c, "MMM"), "M": lambda: F.date_format(c, "MMMM"), "m": lambda: two(F.month(c)), "c": lambda: F.month(c).cast("string"),
        "D": lambda: F.concat(day.cast("string"), suffix), "d": lambda: two(day), "e": lambda: day.cast("string"), "j": lambda: F.lpad(F.dayofyear(c).cast("string"), 3, "0"),
        "H": lambda: two(hour), "k": lambda: hour.cast("string"), "h": lambda: two(twelve), "I": lambda: two(twelve), "l": lambda: twelve.cast("string"),
        "i": lambda: two(F.minute(c)), "p": lambda: half, "r": lambda: F.concat(clock(twelve), F.lit(" "), half), "T": lambda: clock(hour),
        "S": lambda: two(F.second(c)), "s": lambda: two(F.second(c)), "f": lambda: F.date_format(c, "SSSSSS"),
        "U": lambda: two(week(c, 0)), "u": lambda: two(week(c, 1)), "V": lambda: two(week(c, 2)), "v": lambda: two(week(c, 3)),
        "a": lambda: F.date_format(c, "EEE"), "W": lambda: F.date_format(c, "EEEE"), "w": lambda: (F.dayofweek(c) - 1).cast("string"),
        "X": lambda: F.lpad(_week_and_year(c, 2, True)[1].cast("string"), 4, "0"), "x": lambda: F.lpad(_week_and_year(c, 3, True)[1].cast("string"), 4, "0"),
        "Y": lambda: F.lpad(F.year(c).cast("string"), 4, "0"), "y": lambda: two(F.year(c) % 100),
    }
    parts, i = [], 0
    while i < len(layout):
        if layout[i] == "%" and i + 1 < len(layout):
            i += 1
            parts.append(table[layout[i]]() if layout[i] in table else F.lit(layout[i]))
        else:
            parts.append(F.lit(layout[i]))
        i += 1
    return F.when(c.isNotNull(), F.concat(F.lit(""), *parts))


# ---------------------------------------------------------------- durations

def _seconds(d: Column) -> Column:
    """Seconds of an interval, with its microseconds."""
    return d.cast("interval second").cast("decimal(18,6)")


def _micros(d: Column) -> Column:
    """Microseconds of an interval."""
    return (_seconds(d) * 1000000).cast("bigint")


def _interval(micros: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1000000)).cast("decimal(18,6)"))


def hour(d: Column) -> Column:
    """Of a duration: may be over 24."""
    return F.floor(F.abs(_micros(d)) / 3600000000).cast("bigint")


def minute(d: Column) -> Column:
    return F.floor(F.abs(_micros(d)) / 60000000).cast("bigint") % 60


def second(d: Column) -> Column:
    return F.floor(F.abs(_micros(d)) / 1000000).cast("bigint") % 60


def microsecond(d: Column) -> Column:
    return F.abs(_micros(d)) % 1000000


def time_to_sec(d: Column) -> Column:
    return _seconds(d).cast("bigint")


def parse_time(c: Column) -> Column:
    """Text as a duration: [-][d ]h:m[:s[.f]] or digits [h]hmmss[.f]; null if it is neither or its minutes or seconds are over 59."""
    colon = r"^-?(?:(\d{1,2}) )?(\d{1,3}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6})\d*)?)?$"
    plain = r"^-?(\d{1,7})(?:\.(\d{0,6})\d*)?$"
    n = lambda a, i: F.concat(F.lit("0"), F.get(a, F.lit(i))).cast("bigint")
    frac = lambda a, i: F.substring(F.concat(F.get(a, F.lit(i)), F.lit("000000")), 1, 6).cast("bigint")
    parts = lambda t, p, groups: F.split(F.regexp_replace(t, p, groups), ",")

    def by_colon(a: Column) -> Column:
        return F.when((n(a, 2) <= 59) & (n(a, 3) <= 59), ((n(a, 0) * 24 + n(a, 1)) * 3600 + n(a, 2) * 60 + n(a, 3)) * 1000000 + frac(a, 4))

    def by_digits(a: Column) -> Column:
        two = lambda unit: F.floor(n(a, 0) / unit) % 100
        return F.when((two(100) <= 59) & (two(1) <= 59), (F.floor(n(a, 0) / 10000) * 3600 + two(100) * 60 + two(1)) * 1000000 + frac(a, 1))

    def micros(t: Column) -> Column:
        size = F.when(t.rlike(colon), _let(parts(t, colon, "$1,$2,$3,$4,$5,"), by_colon)).when(t.rlike(plain), _let(parts(t, plain, "$1,$2,"), by_digits))
        return F.when(t.startswith("-"), -1).otherwise(1) * size

    return clamp(_interval(_let(F.trim(c), micros)))


def clamp(d: Column, digits: int = 6) -> Column:
    """Durations beyond 838:59:59 become that bound; what is over `digits` digits of a second is rounded, halves away from zero."""
    bound = F.lit(MOST_SECONDS).cast("decimal(18,6)")
    held = _let(F.round(_seconds(d), digits).cast("decimal(18,6)"), lambda s: F.when(s.isNotNull(), F.greatest(F.least(s, bound), -bound)))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), held)


def make_time(h: Column, m: Column, s: Column) -> Column:
    """Null for minutes or seconds outside 0 to 59."""
    total = (F.abs(h).cast("bigint") * 3600 + m.cast("bigint") * 60) * 1000000 + (s * 1000000).cast("bigint")
    bound = MOST_SECONDS * 1000000
    signed = F.when(h < 0, -F.least(total, F.lit(bound))).otherwise(F.least(total, F.lit(bound)))
    return F.when(m.between(0, 59) & (s >= 0) & (s < 60), _interval(signed))


def time_diff(a: Column, b: Column) -> Column:
    """Of two durations, clamped."""
    return clamp(a - b)


def add_time(a: Column, d: Column) -> Column:
    """Timestamp or duration plus duration."""
    return a + d


def sub_time(a: Column, d: Column) -> Column:
    return a - d


def add_time_string(c: Column, d: Column, sign: int = 1) -> Column:
    """Text read as a duration, else as a timestamp, plus a duration, as text; null if it is neither."""
    span = parse_time(c)
    m = _micros(span) + sign * _micros(d)
    ts = F.try_to_timestamp(c) + (d if sign > 0 else -d)
    return F.coalesce(format_time(_interval(m)), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def format_time(d: Column) -> Column:
    """[-]hh:mm:ss[.ffffff]."""
    m = _micros(d)
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    frac = microsecond(d)
    return F.concat(F.when(m < 0, "-").otherwise(""), two(hour(d)), F.lit(":"), two(minute(d)), F.lit(":"), two(second(d)), F.when(frac > 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(""))


#: The parts of composite units, largest first.
UNITS = {
    "SECOND_MICROSECOND": ("SECOND", "MICROSECOND"), "MINUTE_MICROSECOND": ("MINUTE", "SECOND", "MICROSECOND"), "MINUTE_SECOND": ("MINUTE", "SECOND"),
    "HOUR_MICROSECOND": ("HOUR", "MINUTE", "SECOND", "MICROSECOND"), "HOUR_SECOND": ("HOUR", "MINUTE", "SECOND"), "HOUR_MINUTE": ("HOUR", "MINUTE"),
    "DAY_MICROSECOND": ("DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"), "DAY_SECOND": ("DAY", "HOUR", "MINUTE", "SECOND"), "DAY_MINUTE": ("DAY", "HOUR", "MINUTE"),
    "DAY_HOUR": ("DAY", "HOUR"), "YEAR_MONTH": ("YEAR", "MONTH"),
}
_MICROS = {"MICROSECOND": 1, "SECOND": 1000000, "MINUTE": 60000000, "HOUR": 3600000000, "DAY": 86400000000, "WEEK": 7 * 86400000000}
_MONTHS = {"MONTH": 1, "QUARTER": 3, "YEAR": 12}


def _amount(value: Column, unit: str) -> tuple[Column, Column]:
    """(microseconds, months) of a value in a unit; composite units read numbers from text, the last ones given first."""
    if unit in _MICROS:
        v = value.cast("decimal(20,6)") if unit == "SECOND" else F.round(value.cast("decimal(20,6)")).cast("bigint")
        return (v * _MICROS[unit]).cast("bigint"), F.lit(0)
    if unit in _MONTHS:
        return F.lit(0).cast("bigint"), (F.round(value.cast("decimal(20,6)")).cast("int") * _MONTHS[unit]).cast("int")
    names = UNITS[unit]
    text = F.trim(value.cast("string"))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    micros, months = F.lit(0).cast("bigint"), F.lit(0)
    for i, name in enumerate(names):
        at = F.size(numbers) - len(names) + i  # missing leading numbers are 0
        v = F.when(at >= 0, F.get(numbers, at)).otherwise(F.lit("0"))
        v = F.rpad(v, 6, "0").cast("bigint") if name == "MICROSECOND" else v.cast("bigint")
        if name in _MICROS:
            micros = micros + v * _MICROS[name]
        else:
            months = months + v.cast("int") * _MONTHS[name]
    return micros * sign, (months * sign).cast("int")


def date_add(c: Column, value: Column, unit: str, sign: int = 1) -> Column:
    """A timestamp plus a value in one of 20 units; shorter parts first, then months (clamped to their last day)."""
    micros, months = _amount(value, unit.upper())
    moved = c.cast("timestamp") + _interval(micros * sign)
    day = F.add_months(F.to_date(moved), months * sign)
    rest = F.unix_micros(moved) - F.unix_micros(F.date_trunc("DAY", moved))
    return day.cast("timestamp") + _interval(rest)


def date_sub(c: Column, value: Column, unit: str) -> Column:
    return date_add(c, value, unit, -1)


def date_add_text(c: Column, value: Column, unit: str, sign: int = 1) -> Column:
    """Of a date as text or number; a result without a time of day is written as a date; unreadable dates give null."""
    text = c.cast("string")
    text = F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d\d)(\d\d)$", "$1-$2-$3")).otherwise(text)
    out = date_add(F.try_to_timestamp(text), value, unit, sign)
    short = text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") & (out == F.date_trunc("DAY", out))
    return F.when(short, F.date_format(out, "yyyy-MM-dd")).otherwise(F.date_format(out, "yyyy-MM-dd HH:mm:ss"))


def duration_add(d: Column, value: Column, unit: str, sign: int = 1) -> Column:
    """A duration plus a value; null beyond the bound."""
    micros, _ = _amount(value, unit.upper())
    total = _micros(d) + micros * sign
    return F.when(F.abs(total) <= MOST_SECONDS * 1000000, _interval(total))


def period_add(p: Column, n: Column) -> Column:
    """Months added to yyyymm (or yymm)."""
    total = _period_months(p) + n
    return F.when(p == 0, 0).otherwise(F.floor(total / 12) * 100 + total % 12 + 1).cast("bigint")


def period_diff(a: Column, b: Column) -> Column:
    return (_period_months(a) - _period_months(b)).cast("bigint")


def _period_months(p: Column) -> Column:
    y = F.floor(p / 100)
    full = F.when(y < 70, y + 2000).when(y < 100, y + 1900).otherwise(y)
    return full * 12 + p % 100 - 1


def sysdate() -> Column:
    return F.current_timestamp()
