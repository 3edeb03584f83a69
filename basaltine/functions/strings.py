"""String functions.  Positions count characters from 1; `binary` variants count bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed bound on the length of padded and repeated results.
MOST = 16 * 1024 * 1024


def length(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def bit_length(c: Column) -> Column:
    return F.bit_length(c).cast("bigint")


def char_length(c: Column) -> Column:
    return F.char_length(c).cast("bigint")


def ascii_(c: Column) -> Column:
    """First byte."""
    return F.when(c == "", 0).otherwise(F.conv(F.substring(F.hex(c.cast("binary")), 1, 2), 16, 10)).cast("bigint")


def ord_(c: Column) -> Column:
    """The bytes of the first character as a big-endian number; null gives 0."""
    return F.coalesce(F.when(c == "", 0).otherwise(F.conv(F.hex(F.substring(c, 1, 1).cast("binary")), 16, 10)).cast("bigint"), F.lit(0).cast("bigint"))


def bin_(c: Column) -> Column:
    return F.bin(c)


def hex_(c: Column) -> Column:
    return F.hex(c)


def unhex(c: Column) -> Column:
    return F.try_unhex(c) if hasattr(F, "try_unhex") else F.unhex(c)


def oct_int(c: Column) -> Column:
    return F.conv(c.cast("string"), 10, 8)


def oct_string(c: Column) -> Column:
    """Of the leading integer; '' is null, text without digits '0'."""
    digits = F.regexp_extract(F.trim(c), r"^([-+]?[0-9]+)", 1)
    return F.when(c == "", None).when(digits == "", "0").otherwise(F.conv(digits, 10, 8))


def concat(*args: Column) -> Column:
    return F.concat(*args)


def concat_ws(separator: Column, *args: Column) -> Column:
    """Null arguments are left out; a null separator gives null."""
    return F.when(separator.isNotNull(), F.call_function("concat_ws", separator, *args))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def reverse(c: Column) -> Column:
    return F.reverse(c)


def ltrim(c: Column) -> Column:
    return F.ltrim(c)


def rtrim(c: Column) -> Column:
    return F.rtrim(c)


def trim(c: Column, what: str = " ", direction: str = "both") -> Column:
    """Remove whole repetitions of `what` from both ends, or the leading or trailing one."""
    if what == "":
        return c
    one = f"(?:{re.escape(what)})+"
    pattern = {"both": f"^{one}|{one}$", "leading": f"^{one}", "trailing": f"{one}$"}[direction].replace("$", "\\z")
    return F.regexp_replace(c, pattern, "")


def _pad(c: Column, n: Column, pad: Column, left: bool) -> Column:
    made = F.call_function("lpad" if left else "rpad", c, n.cast("int"), pad)
    size = F.char_length(c)
    return F.when((n < 0) | (n > MOST) | ((pad == "") & (n > size)), None).when(n == 0, "").when(pad == "", F.call_function("left", c, n.cast("int"))).otherwise(made)


def lpad(c: Column, n: Column, pad: Column) -> Column:
    return _pad(c, n, pad, True)


def rpad(c: Column, n: Column, pad: Column) -> Column:
    return _pad(c, n, pad, False)


def left(c: Column, n: Column) -> Column:
    return F.when(c.isNull() | n.isNull(), None).when(n <= 0, "").otherwise(F.call_function("left", c, n.cast("int")))


def right(c: Column, n: Column) -> Column:
    return F.when(c.isNull() | n.isNull(), None).when(n <= 0, "").otherwise(F.call_function("right", c, n.cast("int")))


def substring(c: Column, pos: Column, n: Column | None = None) -> Column:
    """Negative positions count from the end; 0 and positions outside give ''."""
    size = F.char_length(c)
    start = F.when(pos > 0, pos).otherwise(size + pos + 1).cast("int")
    n = F.lit(2147483647) if n is None else n
    none = c.isNull() | pos.isNull() | n.isNull()
    return F.when(none, None).when((pos == 0) | (F.abs(pos) > size) | (n <= 0), "").otherwise(F.substring(c, start, n.cast("int")))


def substring_index(c: Column, separator: str, n: int) -> Column:
    return F.substring_index(c, separator, n)


def locate(sub: Column, c: Column, pos: Column | None = None) -> Column:
    """First position at or after `pos`, 0 if there is none; a position below 1 gives 0."""
    if pos is None:
        return F.call_function("locate", sub, c).cast("bigint")
    size = F.char_length(c)
    return F.when(sub.isNull() | c.isNull() | pos.isNull(), None).when((pos < 1) | (pos > size + 1), 0).otherwise(F.call_function("locate", sub, c, pos.cast("int"))).cast("bigint")


def instr(c: Column, sub: Column, ignore_case: bool = False) -> Column:
    return F.call_function("locate", F.lower(sub) if ignore_case else sub, F.lower(c) if ignore_case else c).cast("bigint")


def replace(c: Column, search: Column, new: Column) -> Column:
    return F.when(c.isNull() | search.isNull() | new.isNull(), None).when(search == "", c).otherwise(F.replace(c, search, new))


def insert(c: Column, pos: Column, n: Column, new: Column) -> Column:
    """`n` characters from `pos` replaced; positions outside leave the text, a negative n reaches to the end."""
    size = F.char_length(c)
    none = c.isNull() | pos.isNull() | n.isNull() | new.isNull()
    reach = F.when((n < 0) | (pos + n - 1 > size), size - pos + 1).otherwise(n)
    return F.when(none, None).when((pos < 1) | (pos > size), c).otherwise(F.concat(F.substring(c, F.lit(1), (pos - 1).cast("int")), new, F.substring(c, (pos + reach).cast("int"), F.lit(2147483647))))


def repeat(c: Column, n: Column) -> Column:
    return F.when(c.isNull() | n.isNull(), None).when(n <= 0, "").otherwise(F.repeat(c, n.cast("int")))


def space(n: Column) -> Column:
    return F.when(n.isNull() | (n > MOST), None).when(n <= 0, "").otherwise(F.repeat(F.lit(" "), n.cast("int")))


def strcmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a == b, 0).when(a > b, 1).cast("bigint")


def field(c: Column, *args: Column) -> Column:
    """Position of the first equal argument, 0 if none is or for null."""
    return F.coalesce(F.array_position(F.array(*args), c), F.lit(0)).cast("bigint")


def elt(n: Column, *args: Column) -> Column:
    return F.when((n >= 1) & (n <= len(args)), F.get(F.array(*args), (n - 1).cast("int")))


def make_set(mask: Column, *args: Column) -> Column:
    parts = [F.when(mask.cast("bigint").bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, a) for i, a in enumerate(args)]
    return F.when(mask.isNotNull(), F.concat_ws(",", *parts))


def find_in_set(c: Column, listed: Column) -> Column:
    """0 if absent, or if the text holds a comma."""
    return F.find_in_set(c, listed).cast("bigint")


def quote(c: Column) -> Column:
    """As a literal; null gives the text NULL."""
    out = F.regexp_replace(c, r"([\\'])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("\u0000"), F.lit("\\0")), F.lit("\u001a"), F.lit("\\Z"))
    return F.coalesce(F.concat(F.lit("'"), out, F.lit("'")), F.lit("NULL"))


def to_base64(c: Column) -> Column:
    """With a line break after each 76 characters."""
    plain = F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")
    return F.regexp_replace(plain, r"(.{76})(?=.)", "$1\n")


def from_base64(c: Column) -> Column:
    """Blanks are left out; a length that isn't a multiple of four gives '', undecodable text null."""
    clean = F.regexp_replace(c, r"\s", "")
    ok = clean.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return F.when(F.length(clean) % 4 != 0, F.lit("").cast("binary")).when(ok, F.unbase64(F.when(ok, clean).otherwise("")))


def like(c: Column, pattern: str, escape: str = "\\", ignore_case: bool = False) -> Column:
    """% and _ wildcards; an escape character at the end of the pattern stands for itself."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if ch == "%" else "." if ch == "_" else re.escape(ch)
        i += 1
    return c.rlike(("(?is)" if ignore_case else "(?s)") + "^" + out + "\\z").cast("int").cast("bigint")


def _flags(match_type: str, ignore_case: bool) -> str:
    for ch in match_type:
        if ch not in "cims":
            raise ValueError(f"unknown match type {ch!r}")
        ignore_case = {"c": False, "i": True}.get(ch, ignore_case)
    on = "i" * ignore_case + "m" * ("m" in match_type) + "s" * ("s" in match_type)
    return f"(?{on})" if on else ""


def regexp_like(c: Column, pattern: str, match_type: str = "", ignore_case: bool = False) -> Column:
    if pattern == "":
        raise ValueError("empty pattern")
    return c.rlike(_flags(match_type, ignore_case) + pattern).cast("int").cast("bigint")


def _tail(c: Column, pos: int) -> Column:
    return F.substring(c, pos, 2147483647)


def regexp_substr(c: Column, pattern: str, pos: int = 1, occurrence: int = 1, match_type: str = "") -> Column:
    """The occurrence-th match from `pos`; null if there is none."""
    found = F.regexp_extract_all(_tail(c, pos), F.lit(_flags(match_type, False) + f"({pattern})"), F.lit(1))
    return F.get(found, F.lit(max(occurrence, 1) - 1))


def regexp_instr(c: Column, pattern: str, pos: int = 1, occurrence: int = 1, return_end: bool = False, match_type: str = "") -> Column:
    """Position of the occurrence-th match from `pos` (or after it); 0 if there is none.

    The text before it is what a non-greedy match of that many occurrences leaves out.
    """
    p = _flags(match_type.replace("s", "") + "s", False) if "s" in match_type else _flags(match_type, False)
    k = max(occurrence, 1)
    lead = F.regexp_extract(_tail(c, pos), f"{p}^((?s:.*?)" + f"(?:{pattern})(?s:.*?)" * (k - 1) + f")({pattern})", 1)
    own = regexp_substr(c, pattern, pos, k, match_type)
    at = F.char_length(lead) + pos
    return F.when(c.isNull(), None).when(own.isNull(), 0).otherwise(at + (F.char_length(own) if return_end else 0)).cast("bigint")


def regexp_replace(c: Column, pattern: str, new: str, pos: int = 1, occurrence: int = 0, match_type: str = "") -> Column:
    """All matches from `pos`, or the occurrence-th; \\1 in the replacement is a group."""
    java = re.sub(r"\\(\d)", r"$\1", new.replace("$", r"\$"))
    p = _flags(match_type, False)
    if occurrence == 0:
        return F.concat(F.substring(c, 1, pos - 1), F.regexp_replace(_tail(c, pos), p + pattern, java))
    at = regexp_instr(c, pattern, pos, occurrence, match_type=match_type)
    own = regexp_substr(c, pattern, pos, occurrence, match_type)
    fresh = F.regexp_replace(own, p + pattern, java)
    changed = F.concat(F.substring(c, F.lit(1), (at - 1).cast("int")), fresh, F.substring(c, (at + F.char_length(own)).cast("int"), F.lit(2147483647)))
    return F.when(c.isNull(), None).when(own.isNull(), c).otherwise(changed)
