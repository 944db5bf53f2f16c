"""Column functions: strings, times, base 64, vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column, delimiters: str) -> Column:
    """Parts between any of the delimiters, none empty."""
    quoted = "".join("\\" + c for c in delimiters)
    return F.filter(F.split(text, f"[{quoted}]+"), lambda x: x != "")


def replace_regex(text: Column, pattern: str, replacement: str, ignore_case: bool = False, everywhere: bool = True) -> Column:
    """``$n`` in the replacement is a group."""
    flags = "(?i)" if ignore_case else ""
    if everywhere:
        return F.regexp_replace(text, flags + pattern, replacement)
    moved = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", replacement)  # one group more stands in front
    return F.regexp_replace(text, f"{flags}^([\\s\\S]*?)(?:{pattern})", "$1" + moved)


def trimmed(text: Column, characters: str = " ", left: bool = True, right: bool = True) -> Column:
    out = F.ltrim(text, F.lit(characters)) if left else text
    return F.rtrim(out, F.lit(characters)) if right else out


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "MM/dd/yyyy HH:mm:ss")


def text_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("MM/dd/yyyy HH:mm:ss"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: alpha * p + q)


def argmax(a: Column) -> Column:
    """From 0; the first of several."""
    return F.array_position(a, F.array_max(a)) - 1


def is_power_of_two(n: Column) -> Column:
    return (n > 0) & (F.bit_count(n) == 1)


def floor_log2(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def replaced_characters(text: Column, old: str, new: str) -> Column:
    """Each character of old by the one in its place in new."""
    return F.translate(text, old, new)


def same_text(a: Column, b: Column, ignore_case: bool = False) -> Column:
    return F.lower(a) == F.lower(b) if ignore_case else a == b


def compared_from_end(a: Column, b: Column) -> Column:
    """-1, 0 or 1: the order of two texts read backwards, by code points."""
    x, y = F.reverse(a), F.reverse(b)
    return F.when(x == y, 0).when(x < y, -1).otherwise(1)


def enum_id(text: Column, names: dict[str, int], other: int = -1) -> Column:
    """The number of a name."""
    found = F.lit(other)
    for name, number in names.items():
        found = F.when(text == name, number).otherwise(found)
    return found


def ceil_log2(n: Column) -> Column:
    """Halvings until nothing is left, less one: 0 for 1, and exact for powers of two."""
    return floor_log2(n) + F.when(F.bit_count(n) > 1, 1).otherwise(0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def scaled(alpha: float, a: Column) -> Column:
    return F.transform(a, lambda x: alpha * x.cast("double"))
