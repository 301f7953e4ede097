"""Concise Binary Object Representation (RFC 8949) of plain values: None, booleans, 64-bit integers, floats, bytes, strings, lists and maps."""

from __future__ import annotations

import struct
from collections.abc import Iterator


def _head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([major << 5 | n])
    for code, form in ((24, ">B"), (25, ">H"), (26, ">I"), (27, ">Q")):
        if n < 1 << 8 * struct.calcsize(form):
            return bytes([major << 5 | code]) + struct.pack(form, n)
    raise OverflowError("integers have 64 bits")


def dumps(value) -> bytes:
    if value is None or value is True or value is False:
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, bytes):
        return _head(2, len(value)) + value
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(dumps(k) + dumps(v) for k, v in value.items())
    return _head(4, len(value)) + b"".join(map(dumps, value))


def _read(data: bytes, at: int):
    major, info = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7:
        if info == 27:
            return struct.unpack_from(">d", data, at)[0], at + 8
        return {20: False, 21: True, 22: None}[info], at
    n = info
    if info > 23:
        form = {24: ">B", 25: ">H", 26: ">I", 27: ">Q"}[info]
        (n,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major < 4:
        raw = data[at : at + n]
        return (raw if major == 2 else raw.decode()), at + n
    if major == 4:
        out = []
        for _ in range(n):
            value, at = _read(data, at)
            out.append(value)
        return out, at
    out = {}
    for _ in range(n):
        key, at = _read(data, at)
        out[key], at = _read(data, at)
    return out, at


def loads_all(data: bytes) -> Iterator:
    """The values that stand one after the other."""
    at = 0
    while at < len(data):
        value, at = _read(data, at)
        yield value
