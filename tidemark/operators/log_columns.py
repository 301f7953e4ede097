"""Typed columns of log variables as bytes and back, each kind by its own codec.

A text goes into the codec only if it comes back the same; all others of a column are kept as they are, with their
places. So leading zeros, upper-case or odd hexadecimal texts, names that are no address and times of any form survive.
"""

from __future__ import annotations

import calendar
import re
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.series_bytes import packed, unpacked, varint_decode, varint_encode

#: Lines whose variables are one block of a column.
LINES = 8192
BLOCK = "kind string, block long, n long, plain long, typed long, payload binary"


def _texts(values: list[str]) -> bytes:
    raw = [v.encode() for v in values]
    return packed(varint_encode(np.array([len(r) for r in raw], np.int64)), b"".join(raw))


def _texts_back(data: bytes) -> list[str]:
    sizes, raw = unpacked(data)
    ends = np.cumsum(varint_decode(sizes)).tolist()
    return [raw[i:j].decode() for i, j in zip([0, *ends], ends)]


# One text at a time: to a value and back. A codec takes a text only where both agree.


def _ip(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | d


def _ip_back(n: int) -> str:
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


# The forms of times, by number; the third has no year.
TIMES = ("%Y-%m-%dT%H:%M:%S", "%y%m%d %H%M%S", "%b %d %H:%M:%S", "[%a %b %d %H:%M:%S %Y]")


def _time(text: str) -> tuple[int, int]:
    for form, pattern in enumerate(TIMES):
        try:
            parsed = time.strptime("2000 " + text, "%Y " + pattern) if form == 2 else time.strptime(text, pattern)
        except ValueError:
            continue
        seconds = calendar.timegm(parsed)
        if _time_back((form, seconds)) == text:
            return form, seconds
    raise ValueError(text)


def _time_back(value: tuple[int, int]) -> str:
    return time.strftime(TIMES[value[0]], time.gmtime(value[1]))


def _hex(text: str) -> bytes:
    return bytes.fromhex(text)


def _uuid(text: str) -> bytes:
    return bytes.fromhex(text.replace("-", ""))


def _uuid_back(raw: bytes) -> str:
    h = raw.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))


def _keeps(text: str, there: Callable, back: Callable) -> bool:
    try:
        return back(there(text)) == text
    except (ValueError, OverflowError):
        return False


# Whole columns of texts that their codec keeps


def _addresses(values):
    return np.array([_ip(v) for v in values], "<u4").tobytes()


def _addresses_back(data):
    return [_ip_back(n) for n in np.frombuffer(data, "<u4").tolist()]


def _numbers(values):
    """Varints, or the narrowest whole type where that is smaller."""
    v = np.array([int(x) for x in values], np.int64)
    narrow = next((t for t in ("u1", "<u2", "<u4") if len(v) and v.min() >= 0 and v.max() <= np.iinfo(t).max), "<i8")
    plain, var = v.astype(narrow).tobytes(), varint_encode(v)
    return packed(narrow.encode(), plain) if len(plain) < len(var) else packed(b"varint", var)


def _numbers_back(data):
    form, raw = unpacked(data)
    return list(map(str, (varint_decode(raw) if form == b"varint" else np.frombuffer(raw, form.decode())).tolist()))


def _bytes(values):
    raw = [_hex(v) for v in values]
    return packed(np.array([len(r) for r in raw], "<u2").tobytes(), b"".join(raw))


def _bytes_back(data):
    sizes, raw = unpacked(data)
    ends = np.cumsum(np.frombuffer(sizes, "<u2").astype(np.int64)).tolist()
    return [raw[i:j].hex() for i, j in zip([0, *ends], ends)]


def _uuids(values):
    return b"".join(map(_uuid, values))


def _uuids_back(data):
    return [_uuid_back(data[k : k + 16]) for k in range(0, len(data), 16)]


def _times(values):
    """Forms, and seconds as distances from the time before, the first from zero."""
    parsed = [_time(v) for v in values]
    return packed(bytes(form for form, _ in parsed), varint_encode(np.diff(np.array([s for _, s in parsed], np.int64), prepend=np.int64(0))))


def _times_back(data):
    forms, deltas = unpacked(data)
    return [_time_back(x) for x in zip(forms, np.cumsum(varint_decode(deltas)).tolist())]


def _dictionary(values):
    order = {v: k for k, v in enumerate(dict.fromkeys(values))}
    return packed(_texts(list(order)), varint_encode(np.array([order[v] for v in values], np.int64)))


def _dictionary_back(data):
    table, index = unpacked(data)
    table = _texts_back(table)
    return [table[k] for k in varint_decode(index).tolist()]


def _paths(values):
    """A dictionary of components; for each path how many it has, and their ids."""
    parts = [v.split("/") for v in values]
    order = {p: k for k, p in enumerate(dict.fromkeys(p for path in parts for p in path))}
    return packed(_texts(list(order)), varint_encode(np.array([len(p) for p in parts], np.int64)), varint_encode(np.array([order[p] for path in parts for p in path], np.int64)))


def _paths_back(data):
    table, sizes, ids = unpacked(data)
    table, ends, ids = _texts_back(table), np.cumsum(varint_decode(sizes)).tolist(), varint_decode(ids).tolist()
    return ["/".join(table[k] for k in ids[i:j]) for i, j in zip([0, *ends], ends)]


#: Kind -> (whether the codec keeps a text, column to bytes, bytes to column).
CODECS: dict[str, tuple[Callable, Callable, Callable]] = {
    "IP": (lambda t: _keeps(t, _ip, _ip_back) and _ip(t) < 1 << 32, _addresses, _addresses_back),
    "NUM": (lambda t: re.fullmatch(r"-?[0-9]{1,18}", t) is not None and str(int(t)) == t, _numbers, _numbers_back),
    "HEX": (lambda t: len(t) < 1 << 17 and _keeps(t, _hex, bytes.hex), _bytes, _bytes_back),
    "UUID": (lambda t: _keeps(t, _uuid, _uuid_back) and len(_uuid(t)) == 16, _uuids, _uuids_back),
    "TIMESTAMP": (lambda t: _keeps(t, _time, _time_back), _times, _times_back),
    "BRACKET_TIME": (lambda t: _keeps(t, _time, _time_back), _times, _times_back),
    "PATH": (lambda t: True, _paths, _paths_back),
    "IDENTIFIER": (lambda t: True, _dictionary, _dictionary_back),
}


def encode_texts(kind: str, values: list[str]) -> tuple[bytes, int]:
    """The column as bytes, and how many of its texts the codec keeps."""
    keeps, encode, _ = CODECS.get(kind, (lambda t: False, _texts, _texts_back))
    mask = np.array([keeps(v) for v in values], bool)
    good, others = [v for v, m in zip(values, mask) if m], [v for v, m in zip(values, mask) if not m]
    return packed(varint_encode(np.diff(np.flatnonzero(~mask), prepend=np.int64(0))), _texts(others), encode(good) if good else b""), len(good)


def decode_texts(kind: str, data: bytes, n: int) -> list[str]:
    places, others, good = unpacked(data)
    decode = CODECS.get(kind, (None, None, _texts_back))[2]
    at = set(np.cumsum(varint_decode(places)).tolist())
    rest, kept = iter(_texts_back(others)), iter(decode(good) if good else ())
    return [next(rest) if k in at else next(kept) for k in range(n)]


def encode_variables(variables: DataFrame, lines: int = LINES, level: int = 3) -> DataFrame:
    """BLOCK rows of variables(line_no, pos, kind, text): a column of a kind in a block of lines, with its places."""

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        line, pos = (group[c].to_numpy() for c in ("line_no", "pos"))
        order = np.lexsort((pos, line))
        texts, kind = group["text"].take(pa.array(order)).to_pylist(), group["kind"][0].as_py()
        data, typed = encode_texts(kind, texts)
        payload = zstandard.ZstdCompressor(level).compress(packed(varint_encode(np.diff(line[order], prepend=np.int64(0))), varint_encode(pos[order]), data))
        return pa.table({"kind": [kind], "block": group["block"][:1], "n": pa.array([len(texts)], pa.int64()), "plain": pa.array([sum(len(t.encode()) for t in texts)], pa.int64()), "typed": pa.array([typed], pa.int64()), "payload": [payload]})

    return variables.select("line_no", "pos", "kind", "text", F.floor(F.col("line_no") / lines).alias("block")).groupBy("kind", "block").applyInArrow(run, BLOCK)


def decode_variables(blocks: DataFrame) -> DataFrame:
    """(line_no, pos, kind, text)."""

    def run(batches):
        import zstandard

        for b in batches:
            for row in b.to_pylist():
                line, pos, data = unpacked(zstandard.ZstdDecompressor().decompress(row["payload"]))
                texts = decode_texts(row["kind"], data, row["n"])
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(varint_decode(line))), pa.array(varint_decode(pos)), pa.array([row["kind"]] * row["n"]), pa.array(texts)], names=["line_no", "pos", "kind", "text"])

    return blocks.mapInArrow(run, "line_no long, pos long, kind string, text string")


def column_sizes(blocks: DataFrame) -> DataFrame:
    """(kind, n, typed, plain, bytes)."""
    return blocks.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("typed").alias("typed"), F.sum("plain").alias("plain"), F.sum(F.octet_length("payload")).alias("bytes"))
