"""Vectorised hashes of words and windows for the worker side."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multipliers of the polynomial hashes.
B1, B2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_windows(codes: np.ndarray, size: int, base: np.uint64 = B1) -> np.ndarray:
    """Hash of each run of `size` codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    key = np.full(n, U(size))
    for j in range(size):
        key = key * base + codes[j : n + j]
    return mix(key)


def anchors(keys: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` keys, the index of its least key; which one follows from the window alone.

    Keys are cut to their upper bits and carry their index in the lower ones, so a tie goes to the leftmost.
    """
    n = len(keys) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits, limit = 26, 1 << 25
    if len(keys) > 2 * limit:
        return np.concatenate([anchors(keys[i : min(i + limit, n) + span - 1], span) + i for i in range(0, n, limit)])
    low = U((1 << bits) - 1)
    m, width = (keys & ~low) | np.arange(len(keys), dtype=U), 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[:n], m[span - width : span - width + n])
    return (m[:n] & low).astype(np.int64)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about `size` bytes of the column, one row at least; nulls become empty."""
    for batch in batches:
        text = batch.column(column).cast(pa.binary()).fill_null(b"")
        batch = batch.set_column(column, batch.schema.names[column], text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            stop = min(max(stop, at + 1), at + 4096)
            yield batch.slice(at, stop - at)
            at = stop


#: Keeps the first k of eight little-endian bytes.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Where words are so long, the rest of them is hashed one word at a time.
_LONG = 4096


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def word_spans(texts: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where words begin and end in them, and where each text's words begin (one entry more than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    cut = np.ones(len(data) + 2, bool)  # white space, with one place before and one behind
    cut[1:-1] = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(~cut[1:-1] & (cut[:-2] | edge[:-1]))
    end = np.flatnonzero(~cut[1:-1] & (cut[2:] | edge[1:])) + 1
    return data, begin, end, np.searchsorted(begin, offsets)


def word_codes(texts: pa.BinaryArray, lower: bool = False, seeds: tuple[int, ...] = (0,)) -> tuple:
    """For each seed a 64-bit code for every word of the texts, then where each text's words begin (one entry more than texts).

    A word goes through a bijective mix eight bytes at a time, after its length, so no algebra of the bytes makes
    codes agree; codes of two seeds are independent.
    """
    data, begin, end, at = word_spans(texts)
    if lower:
        data = _LOWER[data]
    length, view, out = end - begin, lanes(data), []
    for seed in seeds:
        start = mix(np.array([seed], U) + B2)[0]
        code = mix(mix((view[begin] & _KEEP[np.minimum(length, 8)]) + start) ^ length.astype(U))
        step, more = 8, np.flatnonzero(length > 8)
        while len(more) and step < _LONG:
            left = length[more] - step
            code[more] = mix((code[more] * B1) ^ (view[begin[more] + step] & _KEEP[np.minimum(left, 8)]))
            more, step = more[left > 8], step + 8
        for k in more.tolist():
            rest = hashlib.blake2b(data[begin[k] + step : end[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            code[k] = mix(np.frombuffer(rest, "<u8") ^ code[k : k + 1])[0]
        out.append(code)
    return *out, at


_powers: dict = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """At least n powers of the base; long ones are not kept."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        up = np.ones(max(n, 1 << 17), U)
        up[1:] = base
        got = np.cumprod(up)
        if len(got) <= 1 << 20:
            _powers[int(base)] = got
    return got


def _inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


class RunHash:
    """Polynomial hashes of any run of codes, from running sums."""

    def __init__(self, codes: np.ndarray, base: np.uint64 = B1):
        n = len(codes)
        self.down = _power(_inverse(base), n + 1)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(codes * _power(base, n + 1)[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:-size]) * self.down[:n]) if n > 0 else np.zeros(0, U)


#: Bytes that one code of a ByteHash covers.
LANE = 8


class ByteHash(RunHash):
    """The same for a byte string, from mixed codes of the eight bytes at each place; which: one of two independent hashes.

    Strings are at least eight bytes long.
    """

    def __init__(self, data: bytes, which: int = 0):
        super().__init__(mix(lanes(np.frombuffer(data, np.uint8)) + (B2, B1)[which]), (B1, B2)[which])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return super().of(start, stop - (LANE - 1))

    def grams(self, size: int) -> np.ndarray:
        return super().grams(size - (LANE - 1))[: max(0, len(self.sums) - size)]


def anchor_runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one anchor."""
    lo = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    return lo, np.diff(np.append(lo, len(at)))


def spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ..., lo + n - 1 of each run, one after the other."""
    return np.repeat(lo, n).astype(np.int64) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def row_slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def key_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, which stand together; a group is small, and one that a batch cuts is put together again."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        new = np.zeros(b.num_rows - 1, bool)
        for c in keys:
            new |= pc.not_equal(b[c][1:], b[c][:-1]).to_numpy(zero_copy_only=False)
        ends = [0, *(np.flatnonzero(new) + 1).tolist()]
        for p, q in zip(ends, ends[1:]):
            yield b.slice(p, q - p)
        held = b.slice(ends[-1])
    if held is not None:
        yield held


def merged(lo: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the ranges lo to stop as ascending ranges that do not touch."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(stop[order]) if len(lo) else stop
    first = np.flatnonzero(np.append(True, lo[1:] > reach[:-1])) if len(lo) else np.zeros(0, np.int64)
    return lo[first], reach[np.append(first[1:] - 1, len(lo) - 1)] if len(lo) else reach


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
