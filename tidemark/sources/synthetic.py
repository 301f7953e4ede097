"""Synthetic points and traces: any number of rows from a seed, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import cached, combined, read_wide_csv
from .views import with_series

#: Size -> series and points of each; traces.
SIZES = {"small": (50, 1_000), "big": (500, 10_000), "huge": (10_000, 10_000)}
TRACES = {"small": 100, "medium": 1_000, "big": 50_000, "huge": 100_000}
# The metrics and the texts of their labels.
METRICS = ("cpu_usage_percent", "memory_usage_percent", "http_requests_total", "http_request_duration_seconds", "disk_io_bytes_total", "network_bytes_total", "active_connections", "queue_size", "error_rate_percent", "response_time_ms")
LABELS = {"host": ("server-a", "server-b", "server-c", "server-d", "server-e"), "region": ("us-east-1", "us-west-2", "eu-west-1", "ap-southeast-1"), "environment": ("prod", "staging", "dev")}


def _uniform(seed: int, *columns: str) -> Column:
    """In [0, 1), from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / float(1 << 53)


def _pick(options: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), F.pmod(index, F.lit(len(options))).cast("int"))


def points(spark: SparkSession, series: int = 50, each: int = 1_000, interval: int = 15, jitter: int = 2, start: int = 1_700_000_000, seed: int = 42) -> DataFrame:
    """Points of so many series: counters that rise, levels with a daily swing and noise, and series that hardly change."""
    d = spark.range(series * each).select(F.col("id").alias("seq"), F.floor(F.col("id") / each).alias("s"), (F.col("id") % each).alias("k"))
    ts = F.lit(start) + F.col("k") * interval + F.floor(_uniform(seed, "s", "k") * (2 * jitter + 1)) - jitter
    noise, base = _uniform(seed + 1, "s", "k"), 10 + 80 * _uniform(seed + 2, "s")
    swing = 1 + 0.3 * F.sin(2 * 3.141592653589793 * F.col("k") * interval / 86_400)
    level = F.round(base * swing + 5 * noise, 2)
    name = _pick(METRICS, F.col("s"))
    value = F.when(F.endswith(name, F.lit("_total")), F.floor(F.col("k") * base + 10 * noise).cast("double")).when(F.col("s") % 7 == 3, F.round(base)).otherwise(level)
    # digits of the series' number choose its labels, so every series has its own
    labels, left = [], F.floor(F.col("s") / len(METRICS))
    for key, texts in LABELS.items():
        labels += [F.lit(key), _pick(texts, left)]
        left = F.floor(left / len(texts))
    labels += [F.lit("instance"), left.cast("string")]
    return with_series(d.select("seq", ts.cast("long").alias("ts_s"), name.alias("metric_name"), F.create_map(*labels).alias("labels"), value.alias("value")))


def metric_data(spark: SparkSession, size: str = "small", generator: str = "synthetic", path: str | None = None, folder: str | None = None, most: int | None = None) -> DataFrame:
    """Points of a generator: synthetic ones of a size, or real ones from wide CSV files under a path; kept in a folder if one is given."""

    def make() -> DataFrame:
        return points(spark, *SIZES[size]) if generator == "synthetic" else combined([read_wide_csv(spark, path)], most)

    return cached(spark, folder, size, generator, make) if folder else make()


#: Pattern -> spans (service, operation, number of the parent, start and duration in parts of the request). Other requests stay at the gateway.
PATTERNS = {
    "browse": (("gateway", "GET /items", None, 0.0, 1.0), ("accounts", "check", 1, 0.05, 0.15), ("catalog", "list", 1, 0.25, 0.6), ("search", "query", 3, 0.3, 0.3), ("cache", "get", 3, 0.65, 0.1)),
    "order": (("gateway", "POST /orders", None, 0.0, 1.0), ("accounts", "check", 1, 0.02, 0.1), ("orders", "create", 1, 0.15, 0.8), ("stock", "reserve", 3, 0.2, 0.2), ("payments", "charge", 3, 0.45, 0.35), ("bank", "transfer", 5, 0.5, 0.25), ("mail", "send", 3, 0.85, 0.05)),
    "health": (("gateway", "GET /health", None, 0.0, 1.0),),
}


def traces(spark: SparkSession, n: int = 100, start: int = 1_700_000_000_000_000_000, error_rate: float = 0.05, seed: int = 42) -> DataFrame:
    """Flat spans of n requests: trace_id, span_id, parent_span_id, names, times in nanoseconds, tags, logs, status_code."""
    kinds = tuple(PATTERNS)
    part = "struct<no:int,service_name:string,operation_name:string,parent:int,at:double,share:double>"
    shapes = [F.array(*(F.struct(F.lit(k + 1), F.lit(s), F.lit(o), F.lit(p), F.lit(float(a)), F.lit(float(d))).cast(part) for k, (s, o, p, a, d) in enumerate(PATTERNS[name]))) for name in kinds]
    t = spark.range(n).select("id", F.floor(_uniform(seed, "id") * len(kinds)).cast("int").alias("kind"), (F.lit(start) + F.col("id") * 10_000_000).alias("t0"), (1e6 * (1 + 200 * _uniform(seed + 1, "id"))).alias("length"))
    s = t.select("*", F.explode(F.get(F.array(*shapes), F.col("kind"))).alias("p")).select("*", "p.*")
    begun = (F.col("t0") + F.floor(F.col("at") * F.col("length"))).cast("long")
    failed = _uniform(seed + 2, "id", "no") < error_rate
    key = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), "id", c)), 16, "0"))
    logs = "array<struct<timestamp:bigint,level:string,message:string>>"
    return s.select(
        F.lower(F.lpad(F.hex("id"), 16, "0")).alias("trace_id"), key(F.col("no")).alias("span_id"), F.when(F.col("parent").isNotNull(), key(F.col("parent"))).alias("parent_span_id"), "operation_name", "service_name",
        begun.alias("start_time"), (begun + F.floor(F.col("share") * F.col("length"))).cast("long").alias("end_time"), F.create_map(F.lit("kind"), _pick(kinds, F.col("kind")), F.lit("service"), F.col("service_name")).alias("tags"),
        F.when(failed, F.array(F.struct(begun, F.lit("ERROR"), F.concat(F.col("service_name"), F.lit(" failed"))))).otherwise(F.array()).cast(logs).alias("logs"), failed.cast("int").alias("status_code"),
    )
