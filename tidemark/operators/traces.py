"""Spans and traces: relationships, call graph, chains, critical paths, ids and orders.

Functions take spans(trace_id, span_no, parent_no, service_name, operation_name, start_time, duration, status_code), flat
and keyed by trace; parent_no is null at a root. tags (a map) and logs (an array of level and message) are used where
a function says so. Windows run within a trace.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import numbered, runs

#: Values of a tag up to which it is mapped.
MAPPED = 10


def _in_trace():
    return Window.partitionBy("trace_id").orderBy("start_time", "span_no")


def span_stats(spans: DataFrame) -> DataFrame:
    return spans.agg(
        F.count("*").alias("spans"), F.countDistinct("trace_id").alias("traces"), F.countDistinct("service_name").alias("services"), F.countDistinct("operation_name").alias("operations"),
        F.round(F.avg((F.col("status_code") != 0).cast("double")), 6).alias("error_rate"), F.round(F.avg("duration") / 1e6, 4).alias("mean_ms"),
    )


def top_services(spans: DataFrame, n: int = 10) -> DataFrame:
    return spans.groupBy("service_name").agg(F.count("*").alias("spans")).orderBy(F.desc("spans"), "service_name").limit(n)


def tags_of(spans: DataFrame, tags: dict[str, Column] | None = None) -> DataFrame:
    """(k, v): a row for each tag of each span, from its map or from the given columns."""
    held = F.create_map(*(x for k, c in tags.items() for x in (F.lit(k), c.cast("string")))) if tags else F.col("tags")
    return spans.select(F.explode(F.map_filter(held, lambda k, v: v.isNotNull())).alias("k", "v"))


def tag_domains(tags: DataFrame, mapped: int = MAPPED) -> DataFrame:
    """(k, domain, mapped) of tags_of."""
    return tags.groupBy("k").agg(F.countDistinct("v").alias("domain")).withColumn("mapped", F.col("domain") <= mapped)


def tag_mapping(tags: DataFrame, mapped: int = MAPPED) -> DataFrame:
    """(k, v, key_id, value_id): ids of keys and, where a key has few values, of its values, in order."""
    u = tags.distinct().join(tag_domains(tags, mapped).where("mapped").select("k"), "k")
    return u.select("k", "v", (F.dense_rank().over(Window.orderBy("k")) - 1).cast("long").alias("key_id"), (F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1).cast("long").alias("value_id"))


def calls(spans: DataFrame) -> DataFrame:
    """(trace_id, parent, parent_service, child, child_service) of spans with their parents."""
    c = spans.select("trace_id", F.col("span_no").alias("child"), F.col("parent_no").alias("parent"), F.col("service_name").alias("child_service"))
    p = spans.select("trace_id", F.col("span_no").alias("parent"), F.col("service_name").alias("parent_service"), F.col("start_time").alias("parent_start"))
    return c.join(p, ["trace_id", "parent"])


def call_graph(spans: DataFrame) -> DataFrame:
    return calls(spans).where("parent_service <> child_service").groupBy("parent_service", "child_service").agg(F.count("*").alias("calls"))


def name_ids(spans: DataFrame, column: str = "service_name") -> DataFrame:
    """(column, id) by first appearance. One row a name."""
    s = spans.groupBy(column).agg(F.min(F.struct("trace_id", "start_time", "span_no")).alias("first_"))
    return s.select(column, (F.row_number().over(Window.orderBy("first_")) - 1).cast("long").alias("id"))


def names_to_ids(spans: DataFrame, ids: DataFrame) -> DataFrame:
    column = ids.columns[0]
    return spans.join(ids, column).drop(column).withColumnRenamed("id", f"{column}_id")


def ids_to_names(coded: DataFrame, ids: DataFrame) -> DataFrame:
    column = ids.columns[0]
    return coded.join(ids.withColumnRenamed("id", f"{column}_id"), f"{column}_id").drop(f"{column}_id")


def relationships(spans: DataFrame) -> DataFrame:
    """spans with si, the place in the trace, pi, that of the parent (-1 without one), and std, the time since the trace began."""
    i = spans.withColumn("si", (F.row_number().over(_in_trace()) - 1).cast("long")).withColumn("std", F.col("start_time") - F.first("start_time").over(_in_trace()))
    p = i.select(F.col("trace_id").alias("trace_"), F.col("span_no").alias("parent_"), F.col("si").alias("pi"))
    joined = i.join(p, (F.col("trace_id") == F.col("trace_")) & (F.col("parent_no") == F.col("parent_")), "left")
    return joined.withColumn("pi", F.coalesce("pi", F.lit(-1).cast("long"))).drop("trace_", "parent_")


def from_relationships(rel: DataFrame, starts: DataFrame) -> DataFrame:
    """Spans again from relationships(trace_id, span_no, si, pi, std, ...) and trace starts(trace_id, t0)."""
    p = rel.select(F.col("trace_id").alias("trace_"), F.col("si").alias("si_"), F.col("span_no").alias("parent_no"))
    held = rel.drop("parent_no", "start_time").join(starts, "trace_id").withColumn("start_time", F.col("t0") + F.col("std"))
    held = held.join(p, (F.col("trace_id") == F.col("trace_")) & (F.col("pi") == F.col("si_")), "left")
    return held.select("trace_id", "span_no", "parent_no", "service_name", "operation_name", "start_time", "duration", "status_code")


def trace_starts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id").agg(F.min("start_time").alias("t0"))


def parent_deltas(spans: DataFrame) -> DataFrame:
    rel = relationships(spans)
    return rel.select("trace_id", "si", F.when(F.col("pi") < 0, F.lit(-1).cast("long")).otherwise(F.col("si") - F.col("pi")).alias("parent_delta"))


def global_index(spans: DataFrame) -> DataFrame:
    """spans with gi, the place among all spans by trace and time, and gp, that of a parent that comes earlier, else -1."""
    g = numbered(spans, (), ("trace_id", "start_time", "span_no"), F.floor(F.col("trace_id") / 4096), "gi")
    p = g.select(F.col("trace_id").alias("trace_"), F.col("span_no").alias("parent_"), F.col("gi").alias("gp"))
    joined = g.join(p, (F.col("trace_id") == F.col("trace_")) & (F.col("parent_no") == F.col("parent_")) & (F.col("gp") < F.col("gi")), "left")
    return joined.withColumn("gp", F.coalesce("gp", F.lit(-1).cast("long"))).drop("trace_", "parent_")


def fan_out(spans: DataFrame) -> DataFrame:
    """(trace_id, service_name, services): different services that a span with several children calls; a service's last such span counts."""
    f = calls(spans).groupBy("trace_id", "parent", "parent_service", "parent_start").agg(F.count("*").alias("n"), F.countDistinct("child_service").alias("d"))
    last = F.max_by("d", F.struct("parent_start", "parent"))
    return f.where("n > 1 AND d > 1").groupBy("trace_id", F.col("parent_service").alias("service_name")).agg(last.alias("services"))


def error_chain(spans: DataFrame) -> DataFrame:
    """(trace_id, services, errors): services of spans with errors, by time."""
    own = F.array_sort(F.collect_list(F.struct("start_time", "span_no", "service_name")))  # of one trace
    return spans.where("status_code <> 0").groupBy("trace_id").agg(own.alias("e"), F.count("*").alias("errors")).select("trace_id", F.col("e.service_name").alias("services"), "errors")


def repeated_operations(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace_id", "service_name", "operation_name").agg(F.count("*").alias("times")).where("times > 1")


def leaf_spans(spans: DataFrame) -> DataFrame:
    parents = spans.select(F.col("trace_id").alias("trace_"), F.col("parent_no").alias("parent_"))
    return spans.join(parents, (F.col("trace_id") == F.col("trace_")) & (F.col("span_no") == F.col("parent_")), "left_anti")


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans whose parent is named but not there."""
    held = spans.select(F.col("trace_id").alias("trace_"), F.col("span_no").alias("span_"))
    return spans.where("parent_no IS NOT NULL").join(held, (F.col("trace_id") == F.col("trace_")) & (F.col("parent_no") == F.col("span_")), "left_anti")


def traces_present(wanted: DataFrame, spans: DataFrame) -> DataFrame:
    """wanted(trace_id) with whether any span has it."""
    held = spans.select(F.col("trace_id").alias("trace_")).distinct()
    return wanted.join(held, F.col("trace_id") == F.col("trace_"), "left").select(*wanted.columns, F.col("trace_").isNotNull().alias("present"))


def first_error(spans: DataFrame) -> DataFrame:
    """spans with error_message: the first message of level ERROR of a span that failed, else empty."""
    logs = F.filter("logs", lambda x: x["level"] == "ERROR")
    return spans.withColumn("error_message", F.when(F.col("status_code") != 0, F.coalesce(F.get(logs, 0)["message"], F.lit(""))).otherwise(F.lit("")))


def with_tags(spans: DataFrame) -> DataFrame:
    """spans without the tags that are null."""
    return spans.withColumn("tags", F.map_filter("tags", lambda k, v: v.isNotNull()))


def status_text(code: Column) -> Column:
    return F.when(code == 0, "OK").otherwise("ERROR")


def status_runs(spans: DataFrame) -> DataFrame:
    """(trace_id, start_pos, status_code, run_length) in order of time."""
    placed = spans.select("trace_id", "status_code", (F.row_number().over(_in_trace()) - 1).cast("long").alias("pos"))
    return runs(placed, ("trace_id",), "status_code")


def columns(spans: DataFrame) -> DataFrame:
    """The thirteen columns of a span in global order; tags and logs where the spans have them."""
    g = global_index(first_error(spans) if "logs" in spans.columns else spans.withColumn("error_message", F.lit("")))
    tags = F.col("tags") if "tags" in spans.columns else F.create_map().cast("map<string,string>")
    logs = F.size("logs") if "logs" in spans.columns else F.lit(0)
    return g.select(
        "trace_id", F.col("gi").alias("span_index"), F.col("gp").alias("parent_index"), "service_name", "operation_name", "start_time", (F.col("start_time") + F.col("duration")).alias("end_time"), "duration", "status_code",
        F.map_keys(tags).alias("tag_keys"), F.map_values(tags).alias("tag_values"), logs.cast("long").alias("log_count"), "error_message",
    )


# Whole traces

ANALYSIS = "trace_id long, chain array<string>, critical_path array<string>, critical_total long, errors array<string>, fan_out map<string,long>, repeated map<string,long>"


def _analyze(spans: list[dict]) -> tuple:
    """Of one trace's spans in order of time: without recursion, so depth is no limit; what no root reaches counts for nothing but errors and repeats."""
    children: dict = {}
    for s in spans:
        children.setdefault(s["parent_no"], []).append(s)
    root = children.get(None, [None])[0]
    chain, order = [], []
    if root is not None:
        at = root
        chain.append(at["service_name"])
        while len(children.get(at["span_no"], ())) == 1:
            after = children[at["span_no"]][0]
            if after["service_name"] != at["service_name"]:
                chain.append(after["service_name"])
            at = after
        order = [root]
        for s in order:  # grows on the way: parents before children
            order += children.get(s["span_no"], ())
    total, best = {}, {}
    for s in reversed(order):
        below, chosen = 0, None
        for c in children.get(s["span_no"], ()):
            if total[c["span_no"]] > below:  # the first of equals stays
                below, chosen = total[c["span_no"]], c
        total[s["span_no"]], best[s["span_no"]] = s["duration"] + below, chosen
    path, at = [], root
    while at is not None:
        path.append(at["service_name"])
        at = best[at["span_no"]]
    fan: dict = {}
    repeated: dict = {}
    for s in spans:
        own = children.get(s["span_no"], ())
        services = {c["service_name"] for c in own}
        if len(own) > 1 and len(services) > 1:
            fan[s["service_name"]] = len(services)
        name = f"{s['service_name']}:{s['operation_name']}"
        repeated[name] = repeated.get(name, 0) + 1
    errors = [s["service_name"] for s in spans if s["status_code"] != 0]
    return chain, path, total[root["span_no"]] if root else None, errors, list(fan.items()), [(k, n) for k, n in repeated.items() if n > 1]


def analyze(spans: DataFrame) -> DataFrame:
    """ANALYSIS: a row a trace. Traces stand together and in order of time, and pass through a worker one by one."""
    names = ["trace_id", "span_no", "parent_no", "service_name", "operation_name", "duration", "status_code"]
    kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.string()), pa.map_(pa.string(), pa.int64()), pa.map_(pa.string(), pa.int64()))

    def run(batches):
        held: list[dict] = []

        def done(traces):
            rows = [(t[0]["trace_id"], *_analyze(t)) for t in traces]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ANALYSIS.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            ids, traces, at = b.column(0), [], 0
            rows = b.to_pylist()
            ends = [k + 1 for k, new in enumerate(pc.not_equal(ids[1:], ids[:-1]).to_pylist()) if new]
            for end in (*ends, len(rows)):
                if held and held[0]["trace_id"] != rows[at]["trace_id"]:
                    traces.append(held)
                    held = []
                held += rows[at:end]
                at = end
            if traces:
                yield done(traces)
        if held:
            yield done([held])

    placed = spans.select(*names, "start_time").repartition("trace_id").sortWithinPartitions("trace_id", "start_time", "span_no")
    return placed.select(*names).mapInArrow(run, ANALYSIS)
