"""Series, points and spans as bytes and back: encoded columns, binary tables, CBOR and zstd blocks.

Payloads are made in Arrow workers, a chunk of bounded size at a time. What is read back equals what was written, bit by bit.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cbor
from ..functions import series_bytes as sb
from .metrics import INTERVALS, ordered, rollup_multi
from .sequences import neighbours

#: Points of a series in one payload, rows in a block, bytes of a trained dictionary, zstd level.
CHUNK, BLOCK_ROWS, DICTIONARY, LEVEL = 4096, 1024, 1024, 3
ENCODED = "series string, chunk long, n long, time_method string, times binary, pattern string, value_method string, numbers binary"


def encode_series(points: DataFrame, size: int = CHUNK, level: int = LEVEL) -> DataFrame:
    """ENCODED rows: chunks of a series, each with the codecs that suit its times and the pattern of its values, then zstd."""

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        order, pack = np.argsort(group["pos"].to_numpy()), zstandard.ZstdCompressor(level).compress
        values = group["value"].to_numpy()[order]
        time_method, times = sb.times_encode(group["ts_s"].to_numpy()[order])
        pattern = sb.pattern_of(values)
        value_method, numbers = sb.values_encode(values, pattern)
        row = group["series"][0].as_py(), group["chunk"][0].as_py(), len(values), time_method, pack(times), pattern, value_method, pack(numbers)
        return pa.Table.from_arrays([pa.array([x]) for x in row], names=[c.split()[0] for c in ENCODED.split(", ")])

    p = ordered(points).select("series", F.floor(F.col("pos") / size).alias("chunk"), "pos", "ts_s", F.col("value").cast("double").alias("value"))
    return p.groupBy("series", "chunk").applyInArrow(run, ENCODED)


def decode_series(encoded: DataFrame, size: int = CHUNK) -> DataFrame:
    """(series, pos, ts_s, value) from ENCODED rows."""

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for row in b.to_pylist():
                ts, values = sb.times_decode(row["time_method"], unpack(row["times"])), sb.values_decode(row["value_method"], unpack(row["numbers"]))
                pos = row["chunk"] * size + np.arange(len(ts))
                yield pa.RecordBatch.from_arrays([pa.array([row["series"]] * len(ts)), pa.array(pos), pa.array(ts.astype(np.int64)), pa.array(values)], names=["series", "pos", "ts_s", "value"])

    return encoded.mapInArrow(run, "series string, pos long, ts_s long, value double")


def encoded_sizes(encoded: DataFrame) -> DataFrame:
    """(series, points, bytes)."""
    return encoded.groupBy("series").agg(F.sum("n").alias("points"), F.sum(F.octet_length("times") + F.octet_length("numbers")).alias("bytes"))


def method_counts(encoded: DataFrame) -> DataFrame:
    """(column, method, chunks, points, bytes) for times and values."""
    of = lambda name, method, payload: encoded.groupBy(F.lit(name).alias("column"), F.col(method).alias("method")).agg(F.count("*").alias("chunks"), F.sum("n").alias("points"), F.sum(F.octet_length(payload)).alias("bytes"))
    return of("times", "time_method", "times").union(of("values", "value_method", "numbers"))


def compare_series(points: DataFrame, decoded: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per series: points, places that one side lacks, times that differ, and values off by more than the tolerance."""
    a = ordered(points).select("series", "pos", F.col("ts_s").alias("t"), F.col("value").alias("v"))
    b = decoded.select(F.col("series").alias("series_"), F.col("pos").alias("pos_"), "ts_s", "value")
    both = a.join(b, (F.col("series") == F.col("series_")) & (F.col("pos") == F.col("pos_")), "full_outer")
    count = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    return both.groupBy(F.coalesce("series", "series_").alias("series")).agg(
        F.count("*").alias("points"), count(F.col("pos").isNull() | F.col("pos_").isNull()).alias("lacking"), count(F.col("t") != F.col("ts_s")).alias("wrong_times"), count(F.abs(F.col("v") - F.col("value")) > tolerance).alias("wrong_values"),
    )


def encode_rollups(points: DataFrame, intervals: tuple[int, ...] = INTERVALS) -> DataFrame:
    """ENCODED rows of all intervals' averages; series carry their interval as <seconds>|<series>."""
    rolled = rollup_multi(points, intervals)
    return encode_series(rolled.select(F.concat_ws("|", F.col("interval_seconds").cast("string"), "series").alias("series"), F.col("bucket").alias("ts_s"), F.col("bucket").alias("seq"), F.col("avg_value").alias("value")))


def store_rollups(points: DataFrame, path: str, intervals: tuple[int, ...] = INTERVALS) -> None:
    """The encoded rollups as Parquet, a folder an interval."""
    e = encode_rollups(points, intervals).withColumn("interval_seconds", F.split("series", "[|]", 2)[0].cast("long")).withColumn("series", F.split("series", "[|]", 2)[1])
    e.write.mode("overwrite").partitionBy("interval_seconds").option("compression", "zstd").parquet(path)


def load_rollups(spark, path: str) -> DataFrame:
    """(interval_seconds, series, bucket, avg_value) of stored rollups."""
    e = spark.read.schema(ENCODED + ", interval_seconds long").parquet(path)
    d = decode_series(e.withColumn("series", F.concat_ws("|", F.col("interval_seconds").cast("string"), "series")).drop("interval_seconds"))
    return d.select(F.split("series", "[|]", 2)[0].cast("long").alias("interval_seconds"), F.split("series", "[|]", 2)[1].alias("series"), F.col("ts_s").alias("bucket"), F.col("value").alias("avg_value"))


def xor_bits(points: DataFrame) -> DataFrame:
    """(series, bits, bytes) of the XOR form: 64 for the first value, 1 for a repeat, else 13 and the significant bits."""

    def run(batches):
        for b in batches:
            now, before = (b.column(k).to_numpy(zero_copy_only=False).astype(np.float64).view(np.uint64) for k in (1, 2))
            x = now ^ before
            size = sb.bit_length(x) - sb.bit_length(x & (np.uint64(0) - x)) + 1
            bits = np.where(b.column(3).to_numpy(zero_copy_only=False), 64, np.where(x > 0, 13 + size, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.astype(np.int64))], names=["series", "bits"])

    p = neighbours(ordered(points), ("series",), ("value",), (1,)).select("series", "value", F.coalesce("value_1", F.lit(0.0)).alias("before"), (F.col("pos") == 0).alias("first"))
    return p.mapInArrow(run, "series string, bits long").groupBy("series").agg(F.sum("bits").alias("bits"), F.ceil(F.sum("bits") / 8).alias("bytes"))


# Binary tables


def table_encode(rows: list[tuple[int, str, float, dict[str, str]]]) -> bytes:
    """Row and string counts, the sorted strings with 16-bit lengths, then rows: time, name id, value, number of labels, their ids. Ids have 16 bits, or 32 beyond 65,536 strings."""
    texts = sorted({s for _, name, _, labels in rows for s in (name, *labels, *labels.values())})
    ids = {s: k for k, s in enumerate(texts)}
    form = "H" if len(texts) <= 1 << 16 else "I"
    out = [struct.pack("<II", len(rows), len(texts)), *(struct.pack("<H", len(raw)) + raw for raw in map(str.encode, texts))]
    for ts, name, value, labels in rows:
        pairs = [ids[s] for k in sorted(labels) for s in (k, labels[k])]
        out.append(struct.pack(f"<q{form}dB{len(pairs)}{form}", ts, ids[name], value, len(labels), *pairs))
    return b"".join(out)


def table_decode(data: bytes) -> list[tuple[int, str, float, dict[str, str]]]:
    (n, m), at, texts, rows = struct.unpack_from("<II", data), 8, [], []
    for _ in range(m):
        (size,) = struct.unpack_from("<H", data, at)
        texts.append(data[at + 2 : at + 2 + size].decode())
        at += 2 + size
    form = "H" if m <= 1 << 16 else "I"
    for _ in range(n):
        ts, name, value, k = struct.unpack_from(f"<q{form}dB", data, at)
        at += struct.calcsize(f"<q{form}dB")
        pairs = [texts[i] for i in struct.unpack_from(f"<{2 * k}{form}", data, at)]
        at += struct.calcsize(f"<{2 * k}{form}")
        rows.append((ts, texts[name], value, dict(zip(pairs[::2], pairs[1::2]))))
    return rows


def _blocks(batches, rows: int):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def to_tables(points: DataFrame, rows: int = BLOCK_ROWS, level: int = LEVEL) -> DataFrame:
    """(rows, plain, payload): binary tables of at most `rows` points, their bytes, and the same with zstd."""

    def run(batches):
        import zstandard

        for b in _blocks(batches, rows):
            raw = table_encode([(t, name, v, dict(labels)) for t, name, v, labels in zip(*(c.to_pylist() for c in b.columns))])
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([zstandard.ZstdCompressor(level).compress(raw)])], names=["rows", "plain", "payload"])

    return points.select("ts_s", "metric_name", F.col("value").cast("double"), "labels").mapInArrow(run, "rows long, plain long, payload binary")


def from_tables(tables: DataFrame) -> DataFrame:
    """(ts_s, metric_name, value, labels)."""
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.map_(pa.string(), pa.string()))

    def run(batches):
        import zstandard

        for b in batches:
            for payload in b.column(0).to_pylist():
                rows = table_decode(zstandard.ZstdDecompressor().decompress(payload))
                columns = list(zip(*rows)) or [()] * 4
                columns[3] = [list(x.items()) for x in columns[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ts_s", "metric_name", "value", "labels"])

    return tables.select("payload").mapInArrow(run, "ts_s long, metric_name string, value double, labels map<string,string>")


# CBOR and trained dictionaries

# The compact names of span fields.
COMPACT = {"trace_id": "t", "span_id": "s", "parent_span_id": "p", "operation_name": "o", "service_name": "svc", "start_time": "st", "end_time": "et", "duration_ns": "d", "tags": "tags", "logs": "logs", "status_code": "sc", "status": "stat"}


def compact_spans(spans: DataFrame) -> DataFrame:
    """Span fields under their compact names; a status text OK or ERROR goes, as the code says the same."""
    kept = [F.col(c).alias(short) for c, short in COMPACT.items() if c in spans.columns and c != "status"]
    if "status" in spans.columns:
        kept.append(F.when(~F.col("status").isin("OK", "ERROR"), F.col("status")).alias("stat"))
    return spans.select(*kept)


def _plain(value, kind: pa.DataType):
    if value is not None and pa.types.is_map(kind):
        return {k: _plain(v, kind.item_type) for k, v in value}
    return value


def to_cbor(df: DataFrame, rows: int = BLOCK_ROWS, level: int | None = None, dictionary: bytes | None = None) -> DataFrame:
    """(rows, plain, payload): blocks of CBOR maps one after the other, nulls left out, with zstd where a level is given."""

    def run(batches):
        import zstandard

        trained = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        for b in _blocks(batches, rows):
            kinds = dict(zip(b.schema.names, b.schema.types))
            raw = b"".join(cbor.dumps({c: _plain(v, kinds[c]) for c, v in row.items() if v is not None}) for row in b.to_pylist())
            payload = raw if level is None else zstandard.ZstdCompressor(level, **trained).compress(raw)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([len(raw)], pa.int64()), pa.array([payload])], names=["rows", "plain", "payload"])

    return df.mapInArrow(run, "rows long, plain long, payload binary")


def from_cbor(blocks: DataFrame, schema: str, zstd: bool = False, dictionary: bytes | None = None) -> DataFrame:
    """The rows again; a field that is not there is null."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import zstandard

        trained = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        for b in batches:
            for payload in b.column(0).to_pylist():
                raw = zstandard.ZstdDecompressor(**trained).decompress(payload) if zstd else payload
                rows = list(cbor.loads_all(raw))
                pairs = lambda v: list(v.items()) if isinstance(v, dict) else v
                yield pa.RecordBatch.from_arrays([pa.array([pairs(r.get(f.name)) if pa.types.is_map(f.type) else r.get(f.name) for r in rows], f.type) for f in target], schema=target)

    return blocks.select("payload").mapInArrow(run, schema)


def train_dictionary(df: DataFrame, samples: int = 500, size: int = DICTIONARY) -> bytes:
    """A zstd dictionary of at most `size` bytes from CBOR forms of the first `samples` rows; empty where they are too few."""
    import zstandard

    rows = df.limit(samples).toArrow()
    kinds = dict(zip(rows.schema.names, rows.schema.types))
    texts = [cbor.dumps({c: _plain(v, kinds[c]) for c, v in row.items() if v is not None}) for row in rows.to_pylist()]
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b""
