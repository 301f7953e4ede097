"""Suffix-array dedup of long byte strings by prefix doubling over sampled positions.

Prefix doubling ranks positions by prefixes of growing length until a rank is unique or the length passes the
threshold. Here a rank is a 64-bit name of the prefix, which serves equality as well as a place in an order does,
and positions are sampled, as a row for every byte and round would take many times the input on disk:

1. A window is a string of `size` bytes. Its anchor is the position inside it whose half-size prefix has the least name;
   equal windows have equal anchors. Anchors are about one position in a hundred. Windows with one anchor are
   neighbours and form a region; the anchor's rank at half size is the region's first rank.
2. A round sorts (rank, union) pairs, where the union names all bytes under the region's windows. A rank that is
   unique drops its region: no window of it repeats. Equal pairs repeat as a whole. Where one rank has several
   unions, one region of each goes on.
3. The next round cuts these regions, at places that follow from the anchor, into shorter ones. The string that all
   windows of a region share grows with each round, from half the size to size - WIDTHS[k] + 1 bytes, and it is
   ranked anew at its new offset from the anchor; with regions of a single window it has passed the threshold.

Names decide, 64 bits of the shared string and 64 independent bits of the union, both from non-linear codes.

Defined cases: a null or empty text has 0 bytes; a text shorter than the threshold stays whole; equal strings
that overlap in one text count; repeated rows, and rows that share an id or have none, are texts of their own;
long texts go in segments; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed_texts, per_text, table
from .hashing import B1, LANE, ByteHash, U, anchor_runs, anchors, byte_slices, merged, signed, spread

SIZE = 400
#: Windows of a region in the rounds after the first.
WIDTHS = (8, 1)
#: Window starts that are hashed at once.
SEGMENT = 1 << 19
ROWS = "c long, u long, id long, key int, lo int, n int, d int, alone boolean"


def _batch(ids, keys, found) -> pa.RecordBatch:
    """found: (row in the batch, c, u, lo, n, d, alone) arrays."""
    k, c, u, lo, n, d, alone = (np.concatenate(x) for x in zip(*found))
    at = pa.array(k)
    columns = [pa.array(signed(c)), pa.array(signed(u)), ids.take(at), keys.take(at), *(pa.array(x.astype(np.int32)) for x in (lo, n, d)), pa.array(alone)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROWS.split(", ")])


def _names(shared: np.ndarray, union: np.ndarray, n: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union's name follows from its bytes, its number of windows and where the anchor is in it."""
    return shared, union + off.astype(U) * B1 + n.astype(U)


def regions(texts: DataFrame, size: int = SIZE) -> DataFrame:
    """ROWS of the first round: windows lo to lo + n - 1 share the anchor at lo + d, whose half-size name is c."""
    half = size // 2

    def run(batches):
        for b in byte_slices(batches, 2):
            found = []
            for k, text in enumerate(b.column(2).to_pylist()):
                for at in range(0, len(text) - size + 1, SEGMENT):
                    part = text[at : at + SEGMENT + size - 1]
                    names = ByteHash(part).grams(half)
                    where = anchors(names, size - half + 1)
                    lo, n = anchor_runs(where)
                    d = where[lo] - lo
                    c, u = _names(names[where[lo]], ByteHash(part, 1).of(lo, lo + n - 1 + size), n, d)
                    found.append((np.full(len(lo), k), c, u, at + lo, n, d, np.ones(len(lo), bool)))
            if found:
                yield _batch(b.column(0), b.column(1), found)

    return texts.mapInArrow(run, ROWS)


def cut_regions(texts: DataFrame, chosen: DataFrame, size: int, width: int) -> DataFrame:
    """ROWS of the next round: the chosen ROWS in runs of at most `width` windows, at multiples of it before the anchor."""

    def run(batches):
        for b in byte_slices(batches, 2):
            spans, found = b.column(3), []
            offsets, flat = spans.offsets.to_numpy(), spans.values
            fields = [flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)]
            for k, text in enumerate(b.column(2).to_pylist()):
                lo, n, d, alone = (f[offsets[k] : offsets[k + 1]] for f in fields)
                for segment in np.unique(lo // SEGMENT):
                    base, own = segment * SEGMENT, lo // SEGMENT == segment
                    part = text[base : base + SEGMENT + size - 1]
                    at = spread(lo[own] - base, n[own])
                    region = np.repeat(np.arange(own.sum()), n[own])
                    away = (lo[own] - base + d[own])[region] - at
                    block = away // width
                    first = np.flatnonzero(np.append(True, (region[1:] != region[:-1]) | (block[1:] != block[:-1])))
                    m = np.diff(np.append(first, len(at)))
                    start, shared = at[first], (at + away - block * width)[first]  # in every window of the run
                    c, u = _names(ByteHash(part).of(shared, shared + size - width + 1), ByteHash(part, 1).of(start, start + m - 1 + size), m, (away - block * width)[first])
                    found.append((np.full(len(first), k), c, u, base + start, m, away[first], alone[own][region[first]] > 0))
            if found:
                yield _batch(b.column(0), b.column(1), found)

    return per_text(texts, chosen, "lo", "n", "d", "alone").mapInArrow(run, ROWS)


def repeated_windows(texts: DataFrame, scratch: Scratch, size: int = SIZE, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(id, key, lo, n): runs of window starts whose string also starts elsewhere."""
    assert size // 2 >= LANE and size - max(widths) + 1 >= LANE
    found, marks = scratch.put(regions(texts, size), "round0"), None
    for k, width in enumerate((*widths, 0)):
        # pairs of one rank and one union: a row stands for its copies, and only a row that has none is still open
        pairs = found.groupBy("c", "u").agg(F.count("*").alias("copies"), F.min(F.struct("id", "key", "lo", "n", "d", "alone")).alias("one"))
        pairs = scratch.put(pairs, f"pairs{k}")
        told = pairs.where("copies > 1").select(F.col("c").alias("c_"), F.col("u").alias("u_"))
        gone = found.where("alone").join(told, (F.col("c") == F.col("c_")) & (F.col("u") == F.col("u_"))).select("id", "key", "lo", "n")
        gone = scratch.put(gone, f"gone{k}")
        marks = gone if marks is None else marks.union(gone)
        if width:
            alone = (F.col("copies") == 1) & F.col("one.alone")
            ranks = pairs.groupBy(F.col("c").alias("c_")).agg(F.count("*").alias("kinds"), F.max(alone).alias("open")).where("kinds > 1 AND open").select("c_")
            ranks = scratch.put(ranks, f"ranks{k}")
            chosen = pairs.join(ranks, F.col("c") == F.col("c_"), "left_semi").select("one.id", "one.key", "one.lo", "one.n", "one.d", alone.cast("int").alias("alone"))
            chosen = scratch.put(chosen, f"chosen{k}")
            scratch.drop(f"round{k}", f"pairs{k}", f"ranks{k}")
            found = scratch.put(cut_regions(texts, chosen, size, width), f"round{k + 1}")
            scratch.drop(f"chosen{k}")
        else:
            scratch.drop(f"round{k}", f"pairs{k}")
    return marks


def cut(texts: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text without the bytes under marked windows."""

    def run(batches):
        for b in byte_slices(batches, 2):
            rows, marks = [], b.column(3)
            offsets, flat = marks.offsets.to_numpy(), marks.values
            los, ns = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            for k, text in enumerate(b.column(2).to_pylist()):
                i, j = offsets[k], offsets[k + 1]
                start, stop = merged(los[i:j], np.minimum(los[i:j] + ns[i:j] - 1 + size, len(text)))
                kept = b"".join(text[p:q] for p, q in zip([0, *stop.tolist()], [*start.tolist(), len(text)])) if j > i else text
                rows.append((len(text), len(text) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([b.column(4), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = per_text(texts, runs, "lo", "n", keep=("doc_id",), how="left")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def dedup(spark: SparkSession, docs: DataFrame, size: int = SIZE) -> DataFrame:
    scratch = Scratch(spark, "suffixes")
    texts = keyed_texts(docs)
    return cut(texts, scratch.put(repeated_windows(texts.drop("doc_id"), scratch, size), "runs"), size)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
