"""Columns of spans: profiles, strategies, and blocks of encoded columns that come back as they were.

Rows pass in blocks of bounded size; every column of a block is stored by the strategy that its values call for. Each
strategy is exact; a column that it can't hold is stored raw.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.series_bytes import packed, run_lengths, unpacked, varint_decode, varint_encode

# Limits of the strategy chooser.
FEW, REPEATED, POWERS = 10, 0.1, 0.3
ROWS = 4096
BLOCK = "block string, name string, strategy string, n long, plain long, payload binary"


def nullish(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def profile(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """(c, total, levels, nullish, strategy) of the columns; kinds may give a column the name by which a strategy knows it.

    Column names are taken without a plural s, so start_times and start_time mean the same.
    """
    kinds, types = kinds or {}, dict(df.dtypes)
    whole = [c for c, t in types.items() if t in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    shown = [F.struct(F.lit(c).alias("c"), F.lit(kinds.get(c, c).removesuffix("s")).alias("kind"), F.lit(c in whole).alias("number"), F.col(c).cast("string").alias("v"), nullish(F.col(c)).alias("none"), (power_of_2(F.col(c)) if types[c] in ("int", "bigint") else F.lit(False)).alias("power")) for c in df.columns]
    long = df.select(F.explode(F.array(*shown)).alias("x")).select("x.*")
    p = long.groupBy("c", "kind", "number").agg(F.count("*").alias("total"), F.countDistinct("v").alias("levels"), F.sum(F.col("none").cast("long")).alias("nullish"), F.avg(F.coalesce(F.col("power"), F.lit(False)).cast("double")).alias("powers"))
    strategy = F.when(F.col("levels") <= FEW, "dictionary").when(F.col("kind").isin("start_time", "end_time"), "delta").when((F.col("kind") == "duration") & (F.col("powers") > POWERS), "power_of_2")
    strategy = strategy.when((F.col("kind") == "duration") | F.col("number"), "delta").when(F.col("levels") < REPEATED * F.col("total"), "dictionary").otherwise("run_length")
    return p.select("c", "total", "levels", "nullish", strategy.alias("strategy"))


def power_of_2(x: Column) -> Column:
    return (x > 0) & (x.cast("long").bitwiseAND(x.cast("long") - 1) == 0)


def sorted_deltas(df: DataFrame, key: str, value: str, ties: tuple[str, ...], pieces: int = 64) -> DataFrame:
    """(key, ties, place, delta): the values of each key in order, with the differences from the value before.

    Values are cut at the key's quantiles; a piece, with the last value before it, is one window.
    """
    cuts = df.groupBy(F.col(key).alias("key_")).agg(F.percentile_approx(value, [k / pieces for k in range(1, pieces)], 10_000).alias("cuts"))
    d = df.join(cuts, F.col(key).eqNullSafe(F.col("key_"))).withColumn("piece", F.size(F.filter("cuts", lambda c: c < F.col(value)))).drop("cuts", "key_")
    held = d.groupBy(F.col(key).alias("key_"), F.col("piece").alias("piece_")).agg(F.count("*").alias("n"), F.max(value).alias("last"))
    up = Window.partitionBy("key_").orderBy("piece_")
    held = held.select("key_", "piece_", F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(up).alias("before"))
    inside = Window.partitionBy(key, "piece").orderBy(value, *ties)
    d = d.withColumn("k", F.row_number().over(inside)).withColumn("own", F.lag(value).over(inside)).join(held, F.col(key).eqNullSafe(F.col("key_")) & (F.col("piece") == F.col("piece_")))
    return d.select(key, *ties, (F.col("base") + F.col("k")).alias("place"), (F.col(value) - F.coalesce("own", "before")).alias("delta"))


def power_residual(df: DataFrame, value: str, keep: tuple[str, ...]) -> DataFrame:
    """(keep, exponent, rest, near): the nearest power of two of positive values, the higher of equals, and whether it is within a tenth."""
    low = F.length(F.bin(value)) - 1
    shifted = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    lower, upper = shifted(low), shifted(low + 1)
    up = F.col(value) - lower >= upper - F.col(value)
    e = df.where(F.col(value) > 0).withColumn("exponent", (low + up.cast("int")).cast("long")).withColumn("rest", F.col(value) - F.when(up, upper).otherwise(lower))
    return e.select(*keep, "exponent", "rest", (F.abs("rest") < 0.1 * (F.col(value) - F.col("rest"))).alias("near"))


# Blocks


def choose(name: str, values: list) -> str:
    """The strategy of a column in memory, by the rules of profile."""
    distinct = len({json.dumps(v) for v in values})
    kind, number = name.removesuffix("s"), all(isinstance(v, int) and not isinstance(v, bool) for v in values)
    if distinct <= FEW:
        return "dictionary"
    if kind == "duration" and number and sum(v > 0 and v & (v - 1) == 0 for v in values) > POWERS * len(values):
        return "power_of_2"
    if number:
        return "delta"
    return "dictionary" if distinct < REPEATED * len(values) else "run_length"


def _texts(values: list) -> bytes:
    return json.dumps(values, ensure_ascii=False, separators=(",", ":")).encode()


def encode_column(values: list, strategy: str) -> bytes:
    if strategy == "dictionary":  # distinct values by first appearance, then 1, 2 or 4 bytes an index
        order = {t: k for k, t in enumerate(dict.fromkeys(map(json.dumps, values)))}
        width = "u1" if len(order) <= 1 << 8 else "u2" if len(order) <= 1 << 16 else "u4"
        return packed(_texts([json.loads(t) for t in order]), width.encode(), np.array([order[json.dumps(v)] for v in values], width).tobytes())
    if strategy == "delta":  # sorted, with the places that the values came from
        v = np.array(values, np.int64)
        order = np.argsort(v, kind="stable")
        return packed(varint_encode(np.diff(v[order], prepend=np.int64(0))), varint_encode(order))
    if strategy == "power_of_2":  # exponent and rest within a tenth of a power, else exponent -1 and the value
        exponent, rest = [], []
        for v in values:
            e = v.bit_length() - 1 if v > 0 else -1
            if e >= 0 and v - (1 << e) >= (1 << e + 1) - v:
                e += 1
            near = e >= 0 and abs(v - (1 << e)) < 0.1 * (1 << e) and e < 63
            exponent.append(e if near else -1)
            rest.append(v - (1 << e) if near else v)
        return packed(varint_encode(np.array(exponent)), varint_encode(np.array(rest)))
    if strategy == "run_length":
        code = {t: k for k, t in enumerate(dict.fromkeys(map(json.dumps, values)))}
        value, n = run_lengths(np.array([code[json.dumps(v)] for v in values], np.int64))
        return packed(_texts([json.loads(t) for t in code]), varint_encode(value), varint_encode(n))
    return _texts(values)


def decode_column(data: bytes, strategy: str) -> list:
    if strategy == "dictionary":
        table, width, index = unpacked(data)
        table = json.loads(table)
        return [table[k] for k in np.frombuffer(index, width.decode()).tolist()]
    if strategy == "delta":
        deltas, order = map(varint_decode, unpacked(data))
        out = np.zeros(len(order), np.int64)
        out[order] = np.cumsum(deltas)
        return out.tolist()
    if strategy == "power_of_2":
        exponent, rest = (varint_decode(x).tolist() for x in unpacked(data))
        return [r if e < 0 else (1 << e) + r for e, r in zip(exponent, rest)]
    if strategy == "run_length":
        table, value, n = unpacked(data)
        table = json.loads(table)
        return [table[k] for k in np.repeat(varint_decode(value), varint_decode(n)).tolist()]
    return json.loads(data)


def encode_blocks(df: DataFrame, rows: int = ROWS, level: int = 3) -> DataFrame:
    """BLOCK rows, one a column of each block of consecutive rows; columns are integers, strings or lists of them."""

    def run(batches):
        import hashlib

        import zstandard

        for b in batches:
            for at in range(0, b.num_rows, rows):
                part, out = b.slice(at, rows), []
                payloads = []
                for name, column in zip(part.schema.names, part.columns):
                    values = column.to_pylist()
                    strategy = choose(name, values)
                    data = encode_column(values, strategy)
                    if decode_column(data, strategy) != values:
                        strategy, data = "raw", _texts(values)
                    payloads.append((name, strategy, len(values), len(data), zstandard.ZstdCompressor(level).compress(data)))
                block = hashlib.sha256(b"".join(p[-1] for p in payloads)).hexdigest()  # equal blocks hold equal rows; each is kept
                out = [(f"{block}", *p) for p in payloads]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in BLOCK.split(", ")])

    return df.mapInArrow(run, BLOCK)


def decode_blocks(blocks: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of blocks again, with the columns of `like`, in no order. A block of rows is gathered from its columns."""
    target, n = to_arrow_schema(like.schema), len(like.columns)

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        columns: dict[str, list] = {}
        for name, strategy, payload in zip(*(group[c].to_pylist() for c in ("name", "strategy", "payload"))):
            columns.setdefault(name, []).extend(decode_column(zstandard.ZstdDecompressor().decompress(payload), strategy))
        assert len(columns) == n
        return pa.Table.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return blocks.groupBy("block").applyInArrow(run, like.schema)


def column_sizes(blocks: DataFrame) -> DataFrame:
    """(name, strategy, blocks, rows, plain, bytes)."""
    return blocks.groupBy("name", "strategy").agg(F.count("*").alias("blocks"), F.sum("n").alias("rows"), F.sum("plain").alias("plain"), F.sum(F.octet_length("payload")).alias("bytes"))


def compare(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(name, wrong): rows in which a column differs, a row that one side lacks counting for all columns."""
    names = [c for c in a.columns if c not in keys]
    left = a.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("key"), F.struct(*names).alias("x"))
    right = b.select(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))).alias("key_"), F.struct(*names).alias("y"))
    both = left.join(right, F.col("key") == F.col("key_"), "full_outer")
    lacking = F.col("key").isNull() | F.col("key_").isNull()
    wrong = F.array(*(F.struct(F.lit(c).alias("name"), (lacking | ~F.col("x")[c].eqNullSafe(F.col("y")[c])).cast("long").alias("wrong")) for c in names))
    return both.select(F.explode(wrong).alias("e")).groupBy("e.name").agg(F.sum("e.wrong").alias("wrong"))
