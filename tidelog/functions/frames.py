"""The record frame: magic, payload length and CRC, then the payload, all big-endian.

payload = offset 8, timestamp 8, flags 1 (bit 0: a key is present), key length 4, key, value length 4, value,
header count 4, and for each header its name and value with lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the frame format
MAGIC = 0x4D51
FRAME_HEADER = 10
FIXED_PAYLOAD = 29
KEY_PRESENT = 1


def frame_bytes(key: Column, value: Column, headers: Column | None = None) -> Column:
    """Exact bytes of a record's frame, without encoding it."""
    size = F.lit(FRAME_HEADER + FIXED_PAYLOAD) + F.coalesce(F.octet_length(key), F.lit(0)) + F.octet_length(value)
    if headers is not None:
        size = size + F.aggregate(headers, F.lit(0), lambda a, h: a + 8 + F.octet_length(h["key"]) + F.octet_length(h["value"]))
    return size.cast("long")


def _big(value: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


def _sized(value: Column) -> Column:
    return F.concat(_big(F.octet_length(value), 4), value)


def frame(offset: Column, timestamp: Column, key: Column, value: Column, headers: Column | None = None) -> Column:
    """The frame of a record as binary, built inside the JVM."""
    key = key.cast("binary")
    body = [_big(offset, 8), _big(timestamp, 8), _big(key.isNotNull().cast("int"), 1), _sized(F.coalesce(key, F.lit(b""))), _sized(value.cast("binary"))]
    if headers is None:
        body.append(_big(F.lit(0), 4))
    else:
        listed = F.aggregate(headers, F.lit(b""), lambda a, h: F.concat(a, _sized(h["key"].cast("binary")), _sized(h["value"].cast("binary"))))
        body += [_big(F.size(headers), 4), listed]
    payload = F.concat(*body)
    return F.concat(_big(F.lit(MAGIC), 2), _big(F.octet_length(payload), 4), _big(F.crc32(payload), 4), payload)


@dataclass(frozen=True)
class Record:
    offset: int
    timestamp: int
    key: bytes | None
    value: bytes
    headers: tuple[tuple[bytes, bytes], ...] = ()


def pack(r: Record) -> bytes:
    """One record's frame."""
    key = b"" if r.key is None else r.key
    parts = [struct.pack(">QQBI", r.offset, r.timestamp, r.key is not None, len(key)), key, struct.pack(">I", len(r.value)), r.value, struct.pack(">I", len(r.headers))]
    for name, value in r.headers:
        parts += [struct.pack(">I", len(name)), name, struct.pack(">I", len(value)), value]
    payload = b"".join(parts)
    return struct.pack(">HII", MAGIC, len(payload), zlib.crc32(payload)) + payload


class Cut(ValueError):
    """Why a frame could not be read: incomplete, bad_magic, bad_crc or bad_payload."""


def _payload(p: memoryview) -> Record:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(p):
            raise Cut("bad_payload")
        at += n
        return bytes(p[at - n : at])

    number = lambda n: int.from_bytes(take(n), "big")
    offset, stamp, flags = number(8), number(8), number(1)
    key, value = take(number(4)), take(number(4))
    headers = tuple((take(number(4)), take(number(4))) for _ in range(number(4)))
    return Record(offset, stamp, key if flags & KEY_PRESENT else None, value, headers)


def unpack(data: memoryview, at: int = 0) -> tuple[Record, int]:
    """The record at a position and the position after its frame; raises Cut where there is no whole valid frame."""
    if len(data) - at < FRAME_HEADER:
        raise Cut("incomplete")
    magic, size, crc = struct.unpack_from(">HII", data, at)
    if magic != MAGIC:
        raise Cut("bad_magic")
    payload = data[at + FRAME_HEADER : at + FRAME_HEADER + size]
    if len(payload) < size:
        raise Cut("incomplete")
    if zlib.crc32(payload) != crc:
        raise Cut("bad_crc")
    return _payload(payload), at + FRAME_HEADER + size


def scan(data: bytes) -> Iterator[tuple[Record, int, int]]:
    """(record, position, end) of the valid frames at the front; the last end is where a damaged segment may be cut off."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            record, end = unpack(view, at)
        except Cut:
            return
        yield record, at, end
        at = end
