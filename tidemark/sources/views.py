"""Points, spans and log lines as DataFrames, from the driver's tables or from a user's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def series_key(name: Column, labels: Column) -> Column:
    """name{key=value,...} with the labels in the order of their keys."""
    pairs = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def with_series(points: DataFrame) -> DataFrame:
    """points(ts_s, metric_name, labels, value, ...) with their series."""
    return points.withColumn("series", series_key(F.col("metric_name"), F.col("labels")))


def _micros(ts: str) -> Column:  # of a time without zone, whatever the session's zone
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ts_s, metric_name, labels, value, series) of events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    labels = F.create_map(F.lit("region"), F.concat(F.lit("r"), (F.col("user_id") % 3).cast("string")))
    return with_series(e.select(F.col("event_id").alias("seq"), F.floor(_micros("ts") / 1_000_000).alias("ts_s"), F.concat("event_type", F.lit("_value")).alias("metric_name"), labels.alias("labels"), "value"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trace_id, span_no, parent_no, service_name, operation_name, start_time, duration, status_code): an order is a trace, its lines are spans in a binary tree."""
    orders, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem"))
    begun = orders.select(F.col("o_orderkey").alias("trace_id"), (_micros("o_orderdate") * 1000).alias("t0"), "o_totalprice", "o_orderstatus")
    root = begun.select(
        "trace_id", F.lit(1).cast("long").alias("span_no"), F.lit("api-gateway").alias("service_name"), F.lit("route").alias("operation_name"), F.col("t0").alias("start_time"),
        (F.round(F.col("o_totalprice") * 100).cast("long") * 1000).alias("duration"), (F.col("o_orderstatus") == "P").cast("int").alias("status_code"),
    )
    in_trace = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    child = lines.withColumn("n", (F.row_number().over(in_trace) + 1).cast("long")).join(begun, F.col("l_orderkey") == F.col("trace_id")).select(
        "trace_id", F.col("n").alias("span_no"), F.concat(F.lit("svc-"), (F.col("l_suppkey") % 12).cast("string")).alias("service_name"), F.concat("l_returnflag", "l_linestatus").alias("operation_name"),
        (F.col("t0") + F.col("n") * 1_000_000).alias("start_time"), (F.round(F.col("l_extendedprice") * 100).cast("long") * 1000).alias("duration"), (F.col("l_returnflag") == "R").cast("int").alias("status_code"),
    )
    parent = F.when(F.col("span_no") > 1, F.floor(F.col("span_no") / 2))
    return root.unionByName(child).select("trace_id", "span_no", parent.alias("parent_no"), "service_name", "operation_name", "start_time", "duration", "status_code")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, line) of events as web server lines."""
    e, text = spark.read.parquet(f"{sf_dir}/events.parquet"), lambda c: c.cast("string")
    return e.select(F.col("event_id").alias("line_no"), F.concat(
        F.lit("["), F.date_format("ts", "E MMM dd HH:mm:ss yyyy"), F.lit("] ["), F.col("event_type"), F.lit("] [client 10."), text(F.col("user_id") % 256), F.lit("."), text(F.col("event_id") % 256), F.lit(".7] user_"), text(F.col("user_id")),
        F.lit(" took "), text(F.col("value").cast("long")), F.lit(" ms /api/v"), text(F.col("user_id") % 3), F.lit("/"), F.col("event_type"),
    ).alias("line"))
