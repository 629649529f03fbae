"""Device ids as text: base 32 with a check character for each thirteen, in groups of seven. Columns are built-in expressions."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the base-32 alphabet
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def check_character(group: str) -> str:
    """The Luhn character, modulo 32, of a group; weights 1 and 2 alternate from the left."""
    doubled = [ALPHABET.index(c) * (1 + i % 2) for i, c in enumerate(group)]
    total = sum(d // 32 + d % 32 for d in doubled)
    return ALPHABET[-total % 32]


def format_device_id(raw: bytes) -> str:
    """The text of 32 bytes; ValueError for any other length."""
    if len(raw) != 32:
        raise ValueError("a device id has 32 bytes")
    data = base64.b32encode(raw).decode().rstrip("=")
    full = "".join(g + check_character(g) for g in (data[i : i + 13] for i in range(0, 52, 13)))
    return "-".join(full[i : i + 7] for i in range(0, 56, 7))


def parse_device_id(text: str) -> tuple[bytes | None, str | None]:
    """(bytes, None) or (None, which rule the text breaks). Hyphens are ignored, lower case is accepted."""
    bare = text.replace("-", "").upper()
    if len(bare) != 56:
        return None, "length"
    groups = [bare[i : i + 14] for i in range(0, 56, 14)]
    for g in groups:
        if any(c not in ALPHABET for c in g[:13]):
            return None, "character"
        if check_character(g[:13]) != g[13]:
            return None, "check digit"
    return base64.b32decode("".join(g[:13] for g in groups) + "===="), None


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _each(n: int, body) -> Column:
    """The texts body(0) to body(n - 1), joined; null if one of them is."""
    made = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), body)
    return F.when(F.forall(made, lambda x: x.isNotNull()), F.array_join(made, ""))


def check_sign(group: Column) -> Column:
    """The Luhn character, modulo 32, of a group of thirteen signs; null if a sign is none."""

    def add(total: Column, i: Column) -> Column:
        sign = F.substring(group, i + 1, F.lit(1))
        value = (F.ascii(sign) - F.when(sign < "A", 24).otherwise(65)) * (1 + i % 2)  # A to Z are 0 to 25, 2 to 7 are 26 to 31
        return (total + F.floor(value / 32) + value % 32).cast("int")

    total = F.aggregate(F.sequence(F.lit(0), F.lit(12)), F.lit(0), add)
    return F.when(group.rlike(f"^[{ALPHABET}]{{13}}$"), F.substring(F.lit(ALPHABET), F.pmod(-total, F.lit(32)) + 1, F.lit(1)))


def device_id_text(raw: Column) -> Column:
    """Text of a binary column of 32 bytes; null for null and for other lengths. Five hex digits, 20 bits, make four signs."""
    digits = F.when(F.octet_length(raw) == 32, F.rpad(F.hex(raw), 65, "0"))
    signs = _let(digits, lambda d: _each(13, lambda i: F.lpad(F.conv(F.substring(d, 5 * i + 1, F.lit(5)), 16, 32), 4, "0")))
    signs = F.translate(signs, "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)
    full = _let(signs, lambda t: _each(4, lambda i: _let(F.substring(t, 13 * i + 1, F.lit(13)), lambda g: F.concat(g, check_sign(g)))))
    return F.rtrim(_let(full, lambda t: _each(8, lambda i: F.concat(F.substring(t, 7 * i + 1, F.lit(7)), F.lit("-")))), F.lit("-"))


def device_id_bytes(text: Column) -> Column:
    """Struct (raw, error) of a text column; both null for null. Errors as parse_device_id() gives them."""

    def rule(group: Column) -> Column:
        own = F.substring(group, 1, 13)
        return F.when(~own.rlike(f"^[{ALPHABET}]{{13}}$"), "character").when(check_sign(own) != F.substring(group, 14, 1), "check digit")

    def parse(bare: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(bare, 14 * i + 1, F.lit(14)))
        first = F.get(F.filter(F.transform(groups, rule), lambda e: e.isNotNull()), F.lit(0))
        signs = F.translate(F.array_join(F.transform(groups, lambda g: F.substring(g, 1, 13)), ""), ALPHABET, "0123456789ABCDEFGHIJKLMNOPQRSTUV")
        digits = _let(signs, lambda t: _each(13, lambda i: F.lpad(F.conv(F.substring(t, 4 * i + 1, F.lit(4)), 32, 16), 5, "0")))
        error = F.when(F.length(bare) != 56, "length").otherwise(first)
        return _let(error, lambda e: F.struct(F.when(e.isNull(), F.unhex(F.substring(digits, 1, 64))).alias("raw"), e.alias("error")))

    nothing = F.struct(F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("error"))
    return F.when(text.isNull(), nothing).otherwise(_let(F.upper(F.replace(text, F.lit("-"), F.lit(""))), parse))
