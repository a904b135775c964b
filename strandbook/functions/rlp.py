"""The length-prefixed list encoding of payloads: written with expressions, read inside tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with the value written down once, however often ``of`` uses it: nested encodings stay small expressions."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _bytes_of(number: Column) -> Column:
    """A positive number without leading zero bytes."""
    return _once(F.hex(number), lambda h: F.unhex(F.lpad(h, F.length(h) + F.length(h) % 2, F.lit("0"))))


def _prefixed(body: Column, short: int) -> Column:
    def head(n: Column) -> Column:
        long = _once(_bytes_of(n), lambda size: F.concat(F.unhex(F.hex(F.octet_length(size) + short + 55)), size))
        return F.when(n <= 55, F.unhex(F.hex(n + short))).otherwise(long)

    return _once(body, lambda b: F.concat(_once(F.octet_length(b), head), b))


def rlp_bytes(data: Column) -> Column:
    """A string of bytes; a single byte below 0x80 stands for itself."""
    return _once(data, lambda d: F.when((F.octet_length(d) == 1) & (F.hex(d) < "80"), d).otherwise(_prefixed(d, 0x80)))


def rlp_text(text: Column) -> Column:
    return rlp_bytes(F.encode(text, "utf-8"))


def rlp_number(number: Column) -> Column:
    """A non-negative number without leading zero bytes; 0 is the empty string."""
    return rlp_bytes(F.when(number == 0, F.lit(b"")).otherwise(_bytes_of(number)))


def rlp_list(*items: Column) -> Column:
    return _prefixed(F.concat(F.lit(b""), *items), 0xC0)


def read(data: bytes) -> list | bytes:
    """The one item that data encodes: bytes, or a list of items. ValueError for anything else."""
    item, end = _read(data, 0)
    if end != len(data):
        raise ValueError("bytes after the item")
    return item


def _read(data: bytes, at: int) -> tuple[list | bytes, int]:
    if at >= len(data):
        raise ValueError("no item")
    head = data[at]
    if head < 0x80:
        return data[at : at + 1], at + 1
    nested, offset = head >= 0xC0, head - (0xC0 if head >= 0xC0 else 0x80)
    start = at + 1
    if offset > 55:
        width = offset - 55
        size = data[start : start + width]
        if len(size) < width or size[:1] == b"\0" or int.from_bytes(size) < 56:
            raise ValueError("bad length")
        start, offset = start + width, int.from_bytes(size)
    end = start + offset
    if end > len(data) or (not nested and offset == 1 and data[start] < 0x80):
        raise ValueError("item beyond its data, or not in shortest form")
    if not nested:
        return data[start:end], end
    items = []
    while start < end:
        item, start = _read(data, start)
        items.append(item)
    if start != end:
        raise ValueError("item beyond its list")
    return items, end


def number(data: list | bytes, bits: int = 64) -> int:
    if isinstance(data, list) or data[:1] == b"\0" or len(data) * 8 > bits:
        raise ValueError("no number")
    return int.from_bytes(data)
