"""Best-fit packing of token sequences into bins of a fixed capacity.

Pieces above a third of the capacity go at most twice into a bin and are paired by greedy matching, largest
first with the largest partner that fits; smaller pieces best-fit the gaps, largest first. As sizes are whole
numbers up to the capacity, the packing is planned on the histogram of sizes, which does not grow with the
input, and each piece finds its place from its rank among the pieces of its size.

Defined cases: a null or empty text is the end id alone; a longer document is cut into pieces of the full
capacity, only its first piece may be shorter; repeated rows are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .hashing import byte_slices
from .tokens import END, default_tokenizer, encode_column

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END) -> DataFrame:
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in byte_slices(batches, 1):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode_column(b.column(1), path)):
                ids += end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc, k, i, j - i, zlib.crc32(ids[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Places for counts[size] pieces of each size: rows (size, first rank, end rank, pieces a bin, first bin, offset).

    Bins of equal content are handled as one run, so there are at most a few runs for each size.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    large = sorted(s for s in left if 3 * s > capacity)
    runs: list[tuple[int, list[tuple[int, int]]]] = []  # (bins, [(size, pieces in each bin)])
    while large:
        s = large[-1]
        k = bisect.bisect_right(large, capacity - s) - 1
        if k < 0:
            runs.append((left.pop(s), [(s, 1)]))
        elif large[k] == s:
            if left[s] >= 2:
                runs.append((left[s] // 2, [(s, 2)]))
            left[s] %= 2
            if left[s]:  # the odd one pairs with the next smaller size
                if k:
                    t = large[k - 1]
                    runs.append((1, [(s, 1), (t, 1)]))
                    left[t] -= 1
                    if not left[t]:
                        large.pop(k - 1)
                else:
                    runs.append((1, [(s, 1)]))
            left.pop(s)
        else:
            t, n = large[k], min(left[s], left[large[k]])
            runs.append((n, [(s, 1), (t, 1)]))
            left[s] -= n
            left[t] -= n
            if not left[t]:
                large.pop(k)
                left.pop(t)
            if left[s]:
                continue
            left.pop(s)
        large.pop()
    gaps: dict[int, list] = {}  # room left in a bin -> runs with that room
    for n, items in runs:
        gaps.setdefault(capacity - sum(s * k for s, k in items), []).append((n, items))
    rooms = sorted(gaps)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        todo = left[s]
        while todo:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                room, n, items = capacity, -(-todo // (capacity // s)), []
            else:
                room = rooms[at]
                n, items = gaps[room].pop()
                if not gaps[room]:
                    gaps.pop(room)
                    rooms.pop(at)
            each = room // s
            full = min(n, todo // each)
            todo -= full * each
            parts = [(full, each)]
            if full < n and todo:
                parts.append((1, todo))
                todo, full = 0, full + 1
            parts.append((n - full, 0))
            for bins, k in parts:
                if bins:
                    rest = room - k * s
                    if rest not in gaps:
                        gaps[rest] = []
                        bisect.insort(rooms, rest)
                    gaps[rest].append((bins, [*items, (s, k)] if k else items))
    out, ranks, base = [], dict.fromkeys(counts, 0), 0
    for room in sorted(gaps):
        for n, items in gaps[room]:
            offset = 0
            for s, k in items:
                out.append((s, ranks[s], ranks[s] + n * k, k, base, offset))
                ranks[s] += n * k
                offset += s * k
            base += n if items else 0
    assert ranks == {s: max(n, 0) for s, n in counts.items()}
    return out


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of docs(doc_id, text) with sequence_id and offset."""
    scratch = Scratch(spark, "pack")
    cut = scratch.put(pieces(docs, capacity, tokenizer), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    places = spark.createDataFrame(plan(histogram, capacity) or [], "size long, lo long, hi long, each long, bin0 long, offset0 long")
    # rank among pieces of one size: inside buckets of the id, then the buckets' totals; a common size is no single task
    buckets = max(64, sum(histogram.values()) // 50_000)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    totals = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("length").alias("__l"), F.col("bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(totals, (F.col("length") == F.col("__l")) & (F.col("bucket") == F.col("__b")))
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("__before"))
    # the places are at most a few rows for each of `capacity` sizes, whatever the input
    placed = ranked.join(F.broadcast(places), (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin0") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset0") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op7_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
