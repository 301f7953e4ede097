"""Readers of logs, wide CSV and JSON traces, and sinks: JSON lines, zstd Parquet, text with offsets, cached datasets."""

from __future__ import annotations

import hashlib
import os
import shutil
import tarfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.logs import normalized, offsets
from ..operators.sequences import numbered
from .views import with_series

#: Seconds between rows of a file whose times can't be read.
CLOCK = 15


# Logs


def read_logs(spark: SparkSession, path: str, clean: bool = False, most: int | None = None) -> DataFrame:
    """(line_no, line) of text files, in the order of their paths; clean: without blank lines and outer white space, the first `most`.

    A line's place follows from the file and the split it was read in, and from its number in the split: these are
    stable, as text is read in splits of one order. Files are numbered by blocks of lines.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    one = lines.groupBy("file", "start").agg(F.min("at").alias("first_")).withColumnsRenamed({"file": "f_", "start": "s_"})
    placed = lines.join(one, (F.col("file") == F.col("f_")) & (F.col("start") == F.col("s_"))).withColumn("k", F.col("at") - F.col("first_"))
    whole = numbered(placed.select("file", "start", "k", "line"), (), ("file", "start", "k"), F.struct("file", "start", F.floor(F.col("k") / 65536)), "line_no")
    out = whole.select("line_no", "line")
    return normalized(out, most) if clean else out


def unpack_log(archive: str, folder: str) -> str:
    """The path of the largest .log file of a ZIP or tar archive, unpacked into a folder; of any file where none ends so. On the driver, in pieces."""
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            best = max((m for m in z.infolist() if not m.is_dir()), key=lambda m: (m.filename.endswith(".log"), m.file_size, m.filename))
            with z.open(best) as source:
                return _copied(source, folder, best.filename)
    with tarfile.open(archive) as t:
        best = max((m for m in t.getmembers() if m.isfile()), key=lambda m: (m.name.endswith(".log"), m.size, m.name))
        return _copied(t.extractfile(best), folder, best.name)


def _copied(source, folder: str, name: str) -> str:
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, os.path.basename(name))
    with open(path, "wb") as out:
        shutil.copyfileobj(source, out)
    return path


def write_text(lines: DataFrame, path: str) -> None:
    """text/: the lines in order, one file a range; index/: (line_no, start_byte, bytes) as Parquet."""
    lines.select("line_no", "line").repartitionByRange("line_no").sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{path}/text")
    write_dataset(offsets(lines).select("line_no", "start_byte", "bytes"), f"{path}/index", ["line_no"])


# Wide CSV

# Words in a metric's name, in order of precedence, the words that say the unit already, and the suffix.
UNITS = ((("cpu",), ("percent",), "_percent"), (("memory",), ("percent", "bytes"), "_percent"), (("disk",), ("bytes",), "_bytes"), (("network",), ("bytes",), "_bytes"), (("time", "latency"), ("ms",), "_ms"), (("count", "total"), ("total",), "_total"))
# Labels dealt by a hash of the file's name.
ENVIRONMENTS = ("prod", "prod", "prod", "test", "staging")
REGIONS = ("us-east-1", "us-west-2", "eu-west-1", "eu-central-1", "ap-southeast-1", "ap-northeast-1")


def metric_name(column: str) -> str:
    """Lower case, underscores for blanks and dashes, letters and digits only, and a unit where the first rule that fits gives one."""
    name = "".join(c for c in column.lower().replace(" ", "_").replace("-", "_") if c.isalnum() or c == "_")
    for words, said, suffix in UNITS:
        has = any(w in name for w in words)
        if suffix == "_total":
            return name + suffix if has and "total" not in name else name
        if has and not any(w in name for w in said):
            return name + suffix
    return name


def host_of(path: Column) -> Column:
    """The file's name if it speaks of a system, else the first folder that names a node, server or host, else unknown."""
    stem = F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)
    folder = F.get(F.filter(F.split(path, "/"), lambda p: F.lower(p).rlike("node|server|host")), 0)
    return F.when(F.contains(F.lower(stem), F.lit("system")), stem).otherwise(F.coalesce(folder, F.lit("unknown")))


def read_wide_csv(spark: SparkSession, path: str, schema: str | None = None, now: int = 0) -> DataFrame:
    """Points of wide CSV files under a folder: ts_s, seq, metric_name, labels, value, series.

    The time column is timestamp, time or date, else the first. Numbers named timestamp are seconds that end at `now`;
    times in words are parsed; a column that can't be read as times becomes a clock of CLOCK seconds up to `now`. Without
    a schema the types are inferred, which reads the files twice.
    """
    reader = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("positiveInf", "inf").option("negativeInf", "-inf")
    wide = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    stamp = next((c for c in ("timestamp", "time", "date") if c in wide.columns), wide.columns[0])
    types = dict(wide.dtypes)
    wide = wide.select("*", F.col("_metadata.file_path").alias("file_"), F.monotonically_increasing_id().alias("row_"))
    if stamp == "timestamp" and types[stamp] in ("int", "bigint", "double", "float"):
        last = wide.groupBy(F.col("file_").alias("f_")).agg(F.max(stamp).alias("last_"))
        timed = wide.join(last, F.col("file_") == F.col("f_")).withColumn("ts_s", (F.col(stamp) - F.col("last_") + now).cast("long"))
    else:
        timed = wide.withColumn("ts_s", F.unix_seconds(F.col(stamp).try_cast("timestamp")) if types[stamp] not in ("int", "bigint", "double", "float") else F.lit(None).cast("long"))
        sizes = timed.groupBy(F.col("file_").alias("f_")).agg(F.count("*").alias("rows_"), F.min("row_").alias("first_"), F.max(F.col("ts_s").isNull()).alias("bad_"))
        placed = numbered(timed, ("file_",), ("row_",), F.floor(F.col("row_") / 65536), "place_").join(sizes, F.col("file_") == F.col("f_"))
        timed = placed.withColumn("ts_s", F.when(F.col("bad_"), now - CLOCK * (F.col("rows_") - F.col("place_"))).otherwise(F.col("ts_s")))
    numeric = [c for c, t in types.items() if t in ("int", "bigint", "double", "float")]
    stem = F.regexp_extract("file_", r"([^/]+)\.[^./]+$", 1)
    pick = lambda options: F.get(F.array(*map(F.lit, options)), F.pmod(F.crc32(stem.cast("binary")), F.lit(len(options))).cast("int"))
    labels = F.create_map(F.lit("host"), host_of(F.col("file_")), F.lit("region"), pick(REGIONS), F.lit("environment"), pick(ENVIRONMENTS), F.lit("source"), F.lit("real_dataset"))
    ready = timed.select("ts_s", F.col("row_").alias("seq"), labels.alias("labels"), *(F.col(f"`{c}`").cast("double").alias(f"v{k}") for k, c in enumerate(numeric)))
    return with_series(unpivoted(ready, ["ts_s", "seq", "labels"], {f"v{k}": metric_name(c) for k, c in enumerate(numeric)}))


def unpivoted(wide: DataFrame, ids: list[str], names: dict[str, str]) -> DataFrame:
    """A row for each value of the named columns that is a finite number: ids, metric_name, value."""
    cells = F.array(*(F.struct(F.lit(name).alias("metric_name"), F.col(c).cast("double").alias("value")) for c, name in names.items()))
    long = wide.select(*ids, F.explode(cells).alias("cell_")).select(*ids, "cell_.metric_name", "cell_.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))


def sampled(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most so many points, drawn by a hash of seed, time, series and number: the same on every run."""
    return points.orderBy(F.xxhash64(F.lit(seed), "ts_s", "series", "seq"), "seq").limit(most)


def combined(parts: list[DataFrame], most: int | None = None, seed: int = 42) -> DataFrame:
    """Points of several readers, repeats left out, at most `most`, clustered by time."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.dropDuplicates(["series", "ts_s", "seq"])
    out = out if most is None else sampled(out, most, seed)
    return out.repartitionByRange("ts_s").sortWithinPartitions("ts_s", "series", "seq")


# Traces

SPANS = """trace_id string, spans array<struct<trace_id string, span_id string, parent_span_id string, operation_name string, service_name string, start_time long, end_time long,
  tags map<string,string>, logs array<struct<timestamp long, level string, message string>>, status_code int>>"""


def read_traces(spark: SparkSession, path: str, schema: str = SPANS) -> DataFrame:
    """JSON traces, one a line with nested spans, as flat spans with duration_ns and a status text."""
    spans = spark.read.schema(schema).json(path).select(F.explode("spans").alias("s")).select("s.*")
    return spans.withColumn("duration_ns", F.col("end_time") - F.col("start_time")).withColumn("status", F.when(F.col("status_code") == 0, "OK").otherwise("ERROR"))


def nested(spans: DataFrame, key: str = "trace_id", order: tuple[str, ...] = ("start_time",)) -> DataFrame:
    """(key, spans): the spans of a trace in order."""
    others = [c for c in spans.columns if c not in order]
    own = F.collect_list(F.struct(F.struct(*order).alias("order_"), F.struct(*order, *others).alias("span")))  # of one trace
    ranked = F.array_sort(own, lambda a, b: F.when(a["order_"] < b["order_"], -1).when(a["order_"] > b["order_"], 1).otherwise(0))
    return spans.groupBy(key).agg(F.transform(ranked, lambda x: x["span"]).alias("spans"))


def write_traces(spans: DataFrame, path: str) -> None:
    """One JSON trace a line, spans nested."""
    nested(spans).write.mode("overwrite").json(path)


# Sinks


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_size(df: DataFrame) -> DataFrame:
    """(rows, bytes) of the rows as JSON lines."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long") + 1).alias("bytes"))


def write_dataset(df: DataFrame, path: str, sort: list[str], level: int = 3) -> None:
    """Parquet with zstd at a level, clustered by the sort columns."""
    df.repartitionByRange(*sort).sortWithinPartitions(*sort).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store_phase(path: str, **tables: DataFrame) -> None:
    """The tables of a phase, such as templates, lines and encoded columns, as zstd Parquet in folders of one folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/{name}")


def load_phase(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in names}


def cached(spark: SparkSession, folder: str, size: str, generator: str, make) -> DataFrame:
    """The dataset of a size and a generator: read if its folder, named by the MD5 of both, is whole, else made and written."""
    path = f"{folder.rstrip('/')}/{hashlib.md5(f'{size}-{generator}'.encode()).hexdigest()}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def size_text(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, one decimal."""
    unit = lambda k, name: F.concat(F.format_number(n / k, 1), F.lit(name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, " KB")).when(n < 1 << 30, unit(1 << 20, " MB")).otherwise(unit(1 << 30, " GB"))


def phase_summary(sizes: DataFrame) -> DataFrame:
    """sizes(phase, bytes) with ratio to the largest (null for no bytes), size text, and whether it is the smallest; by size."""
    ends = sizes.agg(F.max("bytes").alias("most"), F.min("bytes").alias("least"))
    held = sizes.join(F.broadcast(ends))  # one row
    return held.select("phase", "bytes", size_text(F.col("bytes")).alias("size"), F.round(F.try_divide("most", "bytes"), 4).alias("ratio"), (F.col("bytes") == F.col("least")).alias("best")).orderBy(F.desc("bytes"), "phase")
