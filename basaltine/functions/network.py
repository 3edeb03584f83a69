"""IP addresses."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def inet_aton(c: Column) -> Column:
    """Dotted text as a number; of short forms the last part is the lowest byte; null if a part is over 255."""
    parts = F.split(c, r"\.")
    n = F.size(parts)
    number = lambda i: F.get(parts, F.lit(i)).cast("bigint")
    value = F.lit(None).cast("bigint")
    for k in (4, 3, 2, 1):
        total = number(k - 1)
        for i in range(k - 1):
            total = total + number(i) * (1 << (24 - 8 * i))
        value = F.when(n == k, total).otherwise(value)
    good = c.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){0,3}\z") & F.forall(F.transform(F.when(c.rlike(r"^[0-9.]+\z") & ~c.rlike(r"\.\.|\.\z|^\.") & ~c.rlike("[0-9]{4}"), parts), lambda p: p.cast("int")), lambda p: p <= 255)
    return F.when(good, value)


def inet_ntoa(c: Column) -> Column:
    n = c.cast("bigint")
    parts = [F.call_function("shiftright", n, F.lit(s)).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)]
    return F.when(n.between(0, (1 << 32) - 1), F.concat_ws(".", *parts))


def is_ipv4(c: Column) -> Column:
    """Null gives 0."""
    return F.coalesce(c.rlike(_QUAD), F.lit(False)).cast("int").cast("bigint")


def _packed(text: str | None) -> bytes | None:
    try:
        return None if text is None else ipaddress.ip_address(text).packed
    except ValueError:
        return None


def _text(data: bytes | None) -> str | None:
    try:
        return None if data is None or len(data) not in (4, 16) else str(ipaddress.ip_address(bytes(data)))
    except ValueError:
        return None


def inet6_aton(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(_packed, na_action="ignore"), "binary")(c)


def inet6_ntoa(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(_text, na_action="ignore"), "string")(c)


def is_ipv6(c: Column) -> Column:
    return F.coalesce(F.when(F.instr(c, ":") > 0, F.octet_length(inet6_aton(c)) == 16), F.lit(False)).cast("int").cast("bigint")


def is_ipv4_compat(c: Column) -> Column:
    h = F.hex(c)
    return F.coalesce((F.octet_length(c) == 16) & h.startswith("0" * 24), F.lit(False)).cast("int").cast("bigint")


def is_ipv4_mapped(c: Column) -> Column:
    h = F.hex(c)
    return F.coalesce((F.octet_length(c) == 16) & h.startswith("0" * 20 + "FFFF"), F.lit(False)).cast("int").cast("bigint")


def uuid() -> Column:
    return F.expr("uuid()")
