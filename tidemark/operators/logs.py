"""Log lines: lookup, search, offsets, formats, typed parts and row orders. Templates are in templates.py, column codecs in log_columns.py.

Functions take lines(line_no, line). Numbers and sums over all lines go by blocks of line numbers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series_bytes import varint_decode, varint_encode
from .sequences import BLOCK, neighbours, numbered, running



def _block(c: str = "line_no") -> Column:
    return F.floor(F.col(c) / BLOCK)


def get_line(lines: DataFrame, n: int) -> str:
    """The line of a number; IndexError where there is none."""
    found = lines.where(F.col("line_no") == n).select("line").head(1)
    if not found:
        raise IndexError(f"no line {n}")
    return found[0].line


def line_range(lines: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Lines start to stop - 1 as a slice: negative numbers count from the end, what is outside is left out."""
    if any(x is not None and x < 0 for x in (start, stop)):
        n = (lines.agg(F.max("line_no")).first()[0] or -1) + 1
        start, stop = (x if x is None or x >= 0 else max(0, n + x) for x in (start, stop))
    held = lines if start is None else lines.where(F.col("line_no") >= start)
    return held if stop is None else held.where(F.col("line_no") < stop)


def search(lines: DataFrame, text: str) -> DataFrame:
    """Numbers of the lines that hold the text."""
    return lines.where(F.contains("line", F.lit(text))).select("line_no")


def line_stats(lines: DataFrame) -> DataFrame:
    n = F.length("line")
    return lines.agg(F.count("*").alias("n_lines"), F.round(F.avg(n), 6).alias("mean_len"), F.min(n).cast("long").alias("min_len"), F.max(n).cast("long").alias("max_len"))


def offsets(lines: DataFrame) -> DataFrame:
    """lines with bytes (with the line feed) and start_byte."""
    sized = lines.withColumn("bytes", F.octet_length("line").cast("long") + 1)
    return running(sized, (), ("line_no",), _block(), F.col("bytes"), "stop_").withColumn("start_byte", F.col("stop_") - F.col("bytes")).drop("stop_")


def byte_budget(lines: DataFrame, most: int) -> DataFrame:
    """The longest prefix of at most so many bytes."""
    return offsets(lines).where(F.col("start_byte") + F.col("bytes") <= most).select(*lines.columns)


def normalized(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Lines without white space around them, blank ones left out, numbered anew; the first `most` of them."""
    held = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    held = numbered(held, (), ("line_no",), _block(), "new_").withColumn("line_no", F.col("new_")).drop("new_")
    return held if most is None else held.where(F.col("line_no") < most)


TIME, IP, LEVEL = r"[0-9]{2}:[0-9]{2}:[0-9]{2}", r"[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", r"(?i)\b(DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL)\b"


def formats(lines: DataFrame, level: str = LEVEL, group: int = 1) -> DataFrame:
    """(level, n_lines, with_ip, with_time)."""
    count = lambda p: F.sum(F.col("line").rlike(p).cast("long"))
    return lines.groupBy(F.upper(F.regexp_extract("line", level, group)).alias("level")).agg(F.count("*").alias("n_lines"), count(IP).alias("with_ip"), count(TIME).alias("with_time"))


def samples(lines: DataFrame, n: int = 10, width: int = 200) -> DataFrame:
    """The start of the first n lines."""
    return lines.orderBy("line_no").limit(n).select("line_no", F.substring("line", 1, width).alias("line"))


def prefixes(lines: DataFrame, width: int = 20) -> DataFrame:
    """How many lines begin alike."""
    return lines.groupBy(F.substring("line", 1, width).alias("prefix")).agg(F.count("*").alias("n_lines"))


# Storage


def to_zstd(lines: DataFrame, size: int = 4096, level: int = 3) -> DataFrame:
    """(block, n, plain, payload): lines in order, each with a line feed, as zstd blocks of at most `size` lines."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        texts = group["line"].take(pa.array(np.argsort(group["line_no"].to_numpy()))).to_pylist()
        raw = "".join(t + "\n" for t in texts).encode()
        return pa.table({"block": group["block"][:1], "n": pa.array([len(texts)], pa.int64()), "plain": pa.array([len(raw)], pa.int64()), "payload": [zstandard.ZstdCompressor(level).compress(raw)]})

    return lines.select("line_no", "line", F.floor(F.col("line_no") / size).alias("block")).groupBy("block").applyInArrow(run, "block long, n long, plain long, payload binary")


def from_zstd(blocks: DataFrame, size: int = 4096) -> DataFrame:
    """(line_no, line) of lines whose numbers have no gaps."""

    def run(batches):
        import zstandard

        for b in batches:
            for row in b.to_pylist():
                texts = zstandard.ZstdDecompressor().decompress(row["payload"]).decode().split("\n")[:-1]
                if len(texts) != row["n"]:
                    raise ValueError(f"block {row['block']} does not hold its lines")
                yield pa.RecordBatch.from_arrays([pa.array([row["block"] * size + k for k in range(len(texts))], pa.int64()), pa.array(texts, pa.string())], names=["line_no", "line"])

    return blocks.mapInArrow(run, "line_no long, line string")


# Typed parts


def ip_to_int(text: Column) -> Column:
    """A dotted address as a number; null for anything that would not come back the same."""
    part = lambda k: F.get(F.split(text, "[.]"), k).try_cast("long")
    number = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    return F.when((F.size(F.split(text, "[.]")) == 4) & (int_to_ip(number) == text), number)


def int_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def number_of(text: Column) -> Column:
    """A whole number; null where its text would not come back the same."""
    n = text.try_cast("long")
    return F.when(n.cast("string") == text, n)


def width_of(n: Column) -> Column:
    return F.when(n < 0, "i64").when(n < 1 << 8, "u8").when(n < 1 << 16, "u16").when(n < 1 << 32, "u32").otherwise("u64")


def bracket_seconds(text: Column) -> Column:
    """[Thu Jun 09 06:07:04 2005] as seconds; weekdays are not parsed."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(F.substring(text, 6, 20), F.lit(" Z")), F.lit("MMM dd HH:mm:ss yyyy X")))


def from_base(values: DataFrame, column: str) -> DataFrame:
    """values with base, the first of the column by line, and delta, the distance from it."""
    base = values.where(F.col(column).isNotNull()).agg(F.min_by(column, "line_no").alias("base"))
    return values.join(F.broadcast(base)).withColumn("delta", F.col(column) - F.col("base"))  # one row


def extracted(lines: DataFrame, pattern: str, group: int = 1, name: str = "text") -> DataFrame:
    """(line_no, name) where the pattern matches."""
    return lines.select("line_no", F.regexp_extract("line", pattern, group).alias(name)).where(F.col(name) != "")


def path_parts(paths: DataFrame, column: str = "text") -> DataFrame:
    """(part, uses) of all path components."""
    return paths.select(F.explode(F.filter(F.split(column, "/"), lambda x: x != "")).alias("part")).groupBy("part").agg(F.count("*").alias("uses"))


def first_use_ids(values: DataFrame, column: str = "text") -> DataFrame:
    """(column, uses, id): ids by first appearance."""
    u = values.groupBy(column).agg(F.min("line_no").alias("first_"), F.count("*").alias("uses"))
    return numbered(u, (), ("first_", column), _block("first_"), "id").drop("first_")


# Row orders of templated(line_no, template_id, kinds)


def order_template(t: DataFrame) -> DataFrame:
    """(template_id, line_no, place): lines by template, place within it from 1."""
    return numbered(t.select("template_id", "line_no"), ("template_id",), ("line_no",), _block(), "place").withColumn("place", F.col("place") + 1)


def order_time_clustered(t: DataFrame, most: int = 1000) -> DataFrame:
    """(chunk, line_no, place): by template within chunks of min(most, n div 10 + 1) lines."""
    n = t.count()
    size = min(most, n // 10 + 1)
    w = Window.partitionBy("chunk").orderBy("template_id", "line_no")
    return t.select(F.floor(F.col("line_no") / size).alias("chunk"), "template_id", "line_no").select("chunk", "line_no", F.row_number().over(w).cast("long").alias("place"))


def signature(kinds: Column) -> Column:
    """Sorted (kind, how often) of a line's variables."""
    return F.array_sort(F.transform(F.array_distinct(kinds), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda x: x == k)).alias("n"))))


def order_variables(t: DataFrame) -> DataFrame:
    """(template_id, line_no, place): by template, number of kinds, their counts, then line."""
    s = signature(F.col("kinds"))
    keyed = t.select("template_id", "line_no", F.concat_ws("|", F.lpad(F.size(s).cast("string"), 3, "0"), F.to_json(s)).alias("sig"))
    inside = numbered(keyed, ("template_id", "sig"), ("line_no",), _block(), "own")
    sizes = keyed.groupBy(F.col("template_id").alias("t_"), F.col("sig").alias("s_")).agg(F.count("*").alias("n"))  # a few rows a template
    base = sizes.select("t_", "s_", F.coalesce(F.sum("n").over(Window.partitionBy("t_").orderBy("s_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    placed = inside.join(base, (F.col("template_id") == F.col("t_")) & (F.col("sig") == F.col("s_")))
    return placed.select("template_id", "line_no", (F.col("base") + F.col("own") + 1).alias("place"))


def order_hybrid(t: DataFrame, small: int = 100) -> DataFrame:
    """(template_id, part, line_no, place): small templates by line; larger ones by variables, then hundreds of lines, then line."""
    sizes = t.groupBy(F.col("template_id").alias("t_")).agg(F.count("*").alias("size_"))
    placed = order_variables(t.join(sizes, F.col("template_id") == F.col("t_")).withColumn("kinds", F.when(F.col("size_") > small, F.col("kinds")).otherwise(F.array().cast("array<string>"))))
    return placed.select("template_id", F.floor(F.col("line_no") / small).alias("part"), "line_no", "place")


def order_identity(t: DataFrame) -> DataFrame:
    return t.select("line_no", (F.col("line_no") + 1).alias("place"))


def order_dropped(t: DataFrame) -> DataFrame:
    """What is stored where the order of lines is given up: everything that stands on a line but its number."""
    return t.drop("line_no")


def order_is_dropped(stored: DataFrame) -> bool:
    """Whether nothing that could restore the order is stored."""
    return not {"line_no", "place", "mapping", "offset", "start_byte"} & set(stored.columns)


def mapping_deltas(order: DataFrame) -> DataFrame:
    """(template_id, line_no, delta): the original numbers in the new order, as distances within a template."""
    d = neighbours(order.withColumn("at_", F.col("place") - 1), ("template_id",), ("line_no",), (1,), "at_")
    return d.select("template_id", "line_no", (F.col("line_no") - F.col("line_no_1")).alias("delta"))


def mapping_back(deltas: DataFrame) -> DataFrame:
    """(template_id, line_no, back): numbers again from deltas, the first of a template standing for itself."""
    return running(deltas.withColumn("x_", F.coalesce("delta", "line_no")), ("template_id",), ("line_no",), _block(), F.col("x_"), "back").select("template_id", "line_no", "back")


def run_benefit(t: DataFrame, size: int = 1024) -> DataFrame:
    """(blk, runs_before, runs_after): runs of one template in blocks of lines as they stand, and after ordering."""
    p = neighbours(numbered(t.select("line_no", "template_id"), (), ("line_no",), _block()), (), ("template_id", "line_no"), (1,)).withColumn("blk", F.floor(F.col("line_no") / size))
    new = F.col("template_id_1").isNull() | (F.col("template_id") != F.col("template_id_1")) | (F.floor(F.col("line_no_1") / size) != F.col("blk"))
    return p.groupBy("blk").agg(F.sum(new.cast("long")).alias("runs_before"), F.countDistinct("template_id").alias("runs_after"))


def encode_order(order: DataFrame, size: int = 1 << 16, level: int = 3) -> DataFrame:
    """(template_id, chunk, n, method, payload): original numbers in the new order as zig-zag deltas or 32-bit integers, whichever is smaller after zstd."""

    def run(group: pa.Table) -> pa.Table:
        import numpy as np
        import zstandard

        v = group["line_no"].to_numpy()[np.argsort(group["place"].to_numpy())]
        pack = zstandard.ZstdCompressor(level).compress
        forms = [("delta", pack(varint_encode(np.diff(v, prepend=np.int64(0)))))] + ([("u32", pack(v.astype("<u4").tobytes()))] if len(v) and 0 <= v.min() and v.max() < 1 << 32 else [])
        method, payload = min(forms, key=lambda f: len(f[1]))
        return pa.table({"template_id": group["template_id"][:1], "chunk": group["chunk"][:1], "n": pa.array([len(v)], pa.int64()), "method": [method], "payload": [payload]})

    return order.withColumn("chunk", F.floor((F.col("place") - 1) / size)).select("template_id", "chunk", "place", "line_no").groupBy("template_id", "chunk").applyInArrow(run, "template_id long, chunk long, n long, method string, payload binary")


def decode_order(encoded: DataFrame, size: int = 1 << 16) -> DataFrame:
    """(template_id, place, line_no)."""

    def run(batches):
        import numpy as np
        import zstandard

        for b in batches:
            for row in b.to_pylist():
                raw = zstandard.ZstdDecompressor().decompress(row["payload"])
                v = np.cumsum(varint_decode(raw)) if row["method"] == "delta" else np.frombuffer(raw, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), row["template_id"])), pa.array(row["chunk"] * size + 1 + np.arange(len(v))), pa.array(v)], names=["template_id", "place", "line_no"])

    return encoded.mapInArrow(run, "template_id long, place long, line_no long")
