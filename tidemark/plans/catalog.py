"""Named queries over the driver's tables: each applies an operator, with parameters, to points, spans or lines. Oracles are DuckDB texts of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codecs, columns, log_columns, logs, metrics, templates, traces
from ..sources import files
from ..sources.views import log_lines, metric_points, spans
from . import sql_logs, sql_metrics, sql_traces
from .dialect import Duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _over(view, **named) -> None:
    """Queries that apply a function to a view."""
    for name, f in named.items():
        QUERIES[name] = lambda spark, sf_dir, f=f: f(view(spark, sf_dir))


def query(f):
    """A query of a function of (spark, sf_dir)."""
    QUERIES[f.__name__] = f
    return f


def _joined(c: str):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)


_over(
    metric_points,
    rollup_300s=lambda p: metrics.rollup(p, 300),
    rollup_900s=lambda p: metrics.rollup(p, 900),
    rollup_3600s=lambda p: metrics.rollup(p, 3600),
    rollup_multi=metrics.rollup_multi,
    rollup_full_aggs=metrics.rollup_full,
    rollup_reduction=metrics.rollup_reduction,
    named_filter=lambda p: metrics.series_span(metrics.named(p, "Click")),
    series_catalog=lambda p: metrics.series_catalog(p).select("series_id", "series", "metric_name", F.col("labels")["region"].alias("region"), "points"),
    point_ids=lambda p: metrics.with_series_id(p, metrics.series_catalog(p)).select("seq", "series_id"),
    id_differences=lambda p: metrics.id_differences(metrics.series_catalog(p), metrics.named(metrics.with_series_id(p, metrics.series_catalog(p)), "click")),
    series_arrays=lambda p: metrics.series_arrays(p).select("series", "chunk", _joined("timestamps"), "points"),
    dataset_stats=metrics.dataset_stats,
    label_top10=metrics.label_top,
    key_repetition=metrics.key_repetition,
    type_benefits=metrics.type_benefits,
    string_table=metrics.string_table,
    string_roundtrip=lambda p: metrics.ids_to_strings(metrics.strings_to_ids(p, metrics.string_table(p)), metrics.string_table(p)).select("seq", "metric_name", F.col("labels")["region"].alias("region")),
    string_redundancy=metrics.string_redundancy,
    columnar_benefits=metrics.columnar_benefits,
    series_verify=metrics.unsorted_points,
    ts_delta=lambda p: metrics.deltas(p).select("series", "seq", "delta"),
    ts_double_delta=lambda p: metrics.deltas(p).select("series", "seq", "delta", "dd"),
    rle_runs=metrics.level_runs,
    rle_roundtrip=metrics.runs_back,
    interval_regularity=metrics.interval_regularity,
    gap_spread=lambda p: metrics.gap_spread(p, 600),
    ts_codec_choice=metrics.time_codec,
    series_profile=metrics.series_profile,
    pattern_classify=metrics.classify,
    method_summary=lambda p: metrics.pattern_summary(metrics.classify(p)),
    dict_encode=metrics.value_codes,
    sparse_encode=metrics.non_zero,
    int_split=metrics.whole_and_rest,
    varint_size=metrics.second_difference_bytes,
    delta_zero_share=metrics.zero_deltas,
    metadata_dict=metrics.metadata_dictionaries,
    xor_size=codecs.xor_bits,
    xor_roundtrip=lambda p: codecs.decode_series(codecs.encode_series(p)),
    series_compare=lambda p: codecs.compare_series(p, codecs.decode_series(codecs.encode_series(p))),
    method_counts=lambda p: codecs.method_counts(codecs.encode_series(p)),
    best_and_worst=lambda p: metrics.best_and_worst(codecs.encoded_sizes(codecs.encode_series(p))),
    table_roundtrip=lambda p: codecs.from_tables(codecs.to_tables(p)).select("ts_s", "metric_name", "value", F.col("labels")["region"].alias("region")),
)


@query
def delta_decode_roundtrip(spark, sf_dir):
    d = metrics.deltas(metric_points(spark, sf_dir))
    both = d.select("series", "pos", "ts_s").join(metrics.from_second_differences(d), ["series", "pos"])
    return both.groupBy("series").agg(F.count("*").alias("points"), F.sum((F.col("back") != F.col("ts_s")).cast("long")).alias("wrong"))


@query
def rollup_store(spark, sf_dir):
    d = codecs.decode_series(codecs.encode_rollups(metric_points(spark, sf_dir)))
    at = F.split("series", "[|]", 2)
    return d.select(at[0].cast("long").alias("interval_seconds"), at[1].alias("series"), F.col("ts_s").alias("bucket"), F.col("value").alias("avg_value"))


@query
def cbor_roundtrip(spark, sf_dir):
    p = metric_points(spark, sf_dir).select("seq", "ts_s", "metric_name", "value", "labels")
    back = codecs.from_cbor(codecs.to_cbor(p, level=3), "seq long, ts_s long, metric_name string, value double, labels map<string,string>", zstd=True)
    return back.select("seq", "ts_s", "metric_name", "value", F.col("labels")["region"].alias("region"))


@query
def phase_sizes(spark, sf_dir):
    """Bytes of the points in each form, with ratios to the largest."""
    p = metric_points(spark, sf_dir)
    plain = p.select("ts_s", "metric_name", "value", "labels")
    blocks = lambda name, b, c: b.agg(F.sum(c).alias("bytes")).select(F.lit(name).alias("phase"), "bytes")
    sizes = files.json_size(plain).select(F.lit("ndjson").alias("phase"), "bytes")
    sizes = sizes.union(blocks("cbor", codecs.to_cbor(plain), "plain")).union(blocks("cbor_zstd", codecs.to_cbor(plain, level=3), F.octet_length("payload")))
    sizes = sizes.union(blocks("binary_table", codecs.to_tables(p), "plain")).union(blocks("binary_table_zstd", codecs.to_tables(p), F.octet_length("payload")))
    sizes = sizes.union(codecs.encoded_sizes(codecs.encode_series(p)).agg(F.sum("bytes")).select(F.lit("columnar_zstd"), "sum(bytes)"))
    return files.phase_summary(sizes)


@query
def wide_unpivot(spark, sf_dir):
    """Wide numeric columns to points, null and non-finite values left out."""
    long = files.unpivoted(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"], {c: c for c in ("l_quantity", "l_discount", "l_tax")})
    return long.groupBy("metric_name").agg(F.count("*").alias("points"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.sum("value"), 2).alias("total"))


def _ids(s: DataFrame) -> DataFrame:
    return traces.name_ids(s, "service_name")


def _tags(s: DataFrame) -> DataFrame:
    return traces.tags_of(s, {"service": F.col("service_name"), "operation": F.col("operation_name"), "status": F.col("status_code")})


def _relations(s: DataFrame) -> DataFrame:
    return traces.relationships(s).select("trace_id", "si", "pi", "service_name", "operation_name", "std", "duration", F.col("status_code").cast("long").alias("status_code"))


def _tagged(s: DataFrame) -> DataFrame:
    """Spans with tags, one of them null, and logs, an error's among them where the span failed."""
    log = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("message"))
    first, failed = log("INFO", F.lit("begun")), log("ERROR", F.concat(F.col("service_name"), F.lit(" failed")))
    tags = F.create_map(F.lit("operation"), F.col("operation_name"), F.lit("none"), F.lit(None).cast("string"))
    return traces.with_tags(s.withColumn("tags", tags)).withColumn("logs", F.when(F.col("status_code") != 0, F.array(first, failed)).otherwise(F.array(first)))


_over(
    spans,
    span_stats=traces.span_stats,
    top_services=traces.top_services,
    tag_domains=lambda s: traces.tag_domains(_tags(s)),
    tag_mapping=lambda s: traces.tag_mapping(_tags(s)),
    call_graph=traces.call_graph,
    topology_ids=lambda s: _ids(s).withColumnRenamed("id", "service_id"),
    names_roundtrip=lambda s: traces.ids_to_names(traces.names_to_ids(s, _ids(s)), _ids(s)).select("trace_id", "span_no", "service_name"),
    span_relationships=lambda s: traces.relationships(s).select("trace_id", "si", "pi", "service_name", "operation_name", "std", "duration", "status_code"),
    relationship_roundtrip=lambda s: traces.from_relationships(traces.relationships(s), traces.trace_starts(s)),
    parent_deltas=traces.parent_deltas,
    global_index=lambda s: traces.global_index(s).select("trace_id", "span_no", "gi", "gp"),
    fan_out=traces.fan_out,
    error_chain=lambda s: traces.error_chain(s).select("trace_id", _joined("services"), "errors"),
    repeated_ops=traces.repeated_operations,
    leaf_spans=lambda s: traces.leaf_spans(s).select("trace_id", "span_no", "service_name"),
    orphan_spans=lambda s: traces.orphan_spans(s.where("span_no <> 2")).select("trace_id", "span_no", "parent_no"),
    critical_path=lambda s: traces.analyze(s).select("trace_id", F.col("critical_total").alias("total"), F.array_join("critical_path", ",").alias("services")),
    service_chain=lambda s: traces.analyze(s).select("trace_id", F.array_join("chain", ",").alias("services")),
    trace_analysis=lambda s: traces.analyze(s).select("trace_id", *(F.size(c).cast("long").alias(c) for c in ("errors", "fan_out", "repeated"))),
    nested_traces=lambda s: files.nested(s, order=("start_time", "span_no")).select("trace_id", F.explode("spans").alias("s")).groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("s.duration").alias("total")),
    column_profile=lambda s: columns.profile(s.select("service_name", "operation_name", "start_time", "duration", "parent_no")),
    sorted_delta=lambda s: columns.sorted_deltas(s.select("service_name", "trace_id", "span_no", "duration"), "service_name", "duration", ("trace_id", "span_no")),
    status_rle=traces.status_runs,
    pow2_residual=lambda s: columns.power_residual(s, "duration", ("trace_id", "span_no")),
    span_columns=lambda s: traces.columns(_tagged(s)).withColumn("tag_keys", F.array_join("tag_keys", ",")).withColumn("tag_values", F.array_join("tag_values", ",")),
    trace_columns_roundtrip=lambda s: columns.decode_blocks(columns.encode_blocks(_relations(s)), _relations(s)),
    columns_compare=lambda s: columns.compare(_relations(s), columns.decode_blocks(columns.encode_blocks(_relations(s)), _relations(s)), ("trace_id", "si")),
    span_column_sizes=lambda s: columns.column_sizes(columns.encode_blocks(_relations(s))),
    span_status_text=lambda s: s.select("trace_id", "span_no", F.col("duration").alias("duration_ns"), traces.status_text(F.col("status_code")).alias("status")),
)


@query
def trace_presence(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") + 1).alias("trace_id"))
    return traces.traces_present(wanted, spans(spark, sf_dir))


@query
def cbor_spans(spark, sf_dir):
    """Spans with compact names in CBOR blocks, with zstd and a trained dictionary, and back."""
    s = spans(spark, sf_dir).withColumnRenamed("span_no", "span_id").withColumnRenamed("duration", "duration_ns")
    compact = codecs.compact_spans(s.withColumn("status", traces.status_text(F.col("status_code"))).drop("parent_no"))
    trained = codecs.train_dictionary(compact)
    back = codecs.from_cbor(codecs.to_cbor(compact, level=3, dictionary=trained), "t long, s long, o string, svc string, st long, d long, sc int", zstd=True, dictionary=trained)
    return back.select(F.col("t").alias("trace_id"), F.col("s").alias("span_no"), F.col("svc").alias("service_name"), F.col("o").alias("operation_name"), F.col("st").alias("start_time"), F.col("d").alias("duration"), F.col("sc").alias("status_code"))


def _bracket(lines: DataFrame) -> DataFrame:
    times = logs.extracted(lines, r"^(\[[^\]]*\])")
    return logs.from_base(times.select("line_no", logs.bracket_seconds(F.col("text")).alias("s")), "s").select("line_no", "s", "delta")


_IP = r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)"

_over(
    log_lines,
    log_search=lambda x: logs.search(x, "user_42 "),
    log_range=lambda x: logs.line_range(x, 100, 160),
    line_stats=logs.line_stats,
    line_offsets=lambda x: logs.offsets(x).select("line_no", "start_byte"),
    byte_budget=lambda x: logs.byte_budget(x, 100_000).select("line_no"),
    zstd_lines=lambda x: logs.from_zstd(logs.to_zstd(x)),
    format_analysis=lambda x: logs.formats(x, r"\] \[([a-z_]+)"),
    log_samples=logs.samples,
    log_prefixes=logs.prefixes,
    ip_to_int=lambda x: logs.extracted(x, _IP).select("line_no", logs.ip_to_int(F.col("text")).alias("ip")),
    ip_roundtrip=lambda x: logs.extracted(x, _IP).select("line_no", logs.int_to_ip(logs.ip_to_int(F.col("text"))).alias("ip_text")),
    num_encode=lambda x: logs.extracted(x, "took ([0-9]+) ms").select("line_no", logs.number_of(F.col("text")).alias("num")).withColumn("width", logs.width_of(F.col("num"))),
    bracket_time_delta=_bracket,
    path_components=lambda x: logs.path_parts(logs.extracted(x, "(/api/[^ ]+)")),
    identifier_dict=lambda x: logs.first_use_ids(logs.extracted(x, "(user_[0-9]+)", name="s"), "s"),
)


def _templated(lines: DataFrame) -> DataFrame:
    e = templates.extract(lines)
    return templates.with_template_id(e, templates.dictionary(e))


def _restored(t: DataFrame) -> DataFrame:
    back = logs.mapping_back(logs.mapping_deltas(logs.order_template(t)))
    return back.agg(F.count("*").alias("n_lines"), F.sum((F.col("back") != F.col("line_no")).cast("long")).alias("wrong"))


_over(
    lambda spark, sf_dir: _templated(log_lines(spark, sf_dir)),
    order_template=logs.order_template,
    order_timecluster=logs.order_time_clustered,
    order_variables=logs.order_variables,
    order_hybrid=logs.order_hybrid,
    order_identity=logs.order_identity,
    order_mapping_delta=lambda t: logs.mapping_deltas(logs.order_template(t)),
    order_restore=_restored,
    order_roundtrip=lambda t: logs.decode_order(logs.encode_order(logs.order_template(t))),
    order_benefit_runs=logs.run_benefit,
)
_over(
    lambda spark, sf_dir: templates.extract(log_lines(spark, sf_dir)),
    template_extract=lambda e: e.select("line_no", "template"),
    template_top20=lambda e: templates.top(templates.dictionary(e)),
    template_dict=templates.dictionary,
    variable_columns=templates.variables,
    variable_counts=templates.counts,
    template_roundtrip=lambda e: templates.verify(templates.rebuild(e)),
    template_breakdown=lambda e: templates.breakdown(e, templates.dictionary(e)),
    log_columns_roundtrip=lambda e: log_columns.decode_variables(log_columns.encode_variables(templates.variables(e))),
    log_column_sizes=lambda e: log_columns.column_sizes(log_columns.encode_variables(templates.variables(e))).drop("bytes"),
)


@query
def document_templates(spark, sf_dir):
    """Template frequencies over the lines of all documents: free text, no SQL form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select(F.col("line_no").cast("long").alias("line_no"), "line")
    return templates.extract(lines).groupBy("template").agg(F.count("*").alias("n_lines"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: f(Duck()) for name, f in (sql_metrics.QUERIES | sql_traces.QUERIES | sql_logs.QUERIES).items()}
