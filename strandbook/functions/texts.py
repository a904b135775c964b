"""Hexadecimal texts, method selectors, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_text(data: Column | str) -> Column:
    """Bytes as lower-case hexadecimal digits after 0x; null for null."""
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))


def from_hex(text: Column | str) -> Column:
    """Bytes of hexadecimal digits, with or without 0x; null where the text is none or has an odd number of digits."""
    digits = F.regexp_replace(text, "^0[xX]", "")
    return F.when(digits.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(digits))


def from_hex_array(texts: Column | str) -> Column:
    return F.transform(texts, from_hex)


def selector(data: Column | str) -> Column:
    """The first four bytes of call data."""
    return F.substring(data, 1, 4)


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def day_text(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def hour_text(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def rfc3339(seconds: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
