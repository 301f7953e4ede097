"""Operators on a user's own frames: parameters, edges, readers, sinks and generators."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import codecs, columns, log_columns, logs, metrics, sequences, templates, traces
from tidemark.sources import files, synthetic
from tidemark.sources.views import with_series


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, 15 * k + (k % 7 == 0), "cpu" if k % 3 else "mem", {"host": f"h{k % 2}", "zone": "z"}, float(k % 5)) for k in range(400)]
    return with_series(spark.createDataFrame(rows, "seq long, ts_s long, metric_name string, labels map<string,string>, value double"))


def test_sequences_in_blocks(spark):
    """Numbers, neighbours and runs do not depend on where blocks are cut."""
    rng = random.Random(1)
    rows = [(g, t, rng.randrange(3)) for g, n in (("a", 100), ("b", 1), (None, 37)) for t in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    p = sequences.numbered(df, ("g",), ("t",), F.floor(F.col("t") / 90))
    near = {(r.g, r.pos): r for r in sequences.neighbours(p, ("g",), ("v", "t"), (1, 3, -2), size=8).collect()}
    found = sorted((str(r.g), r.start_pos, r.v, r.run_length) for r in sequences.runs(p, ("g",), "v").collect())
    back = sorted((str(r.g), r.pos, r.v) for r in sequences.expanded(sequences.runs(p, ("g",), "v"), ("g",), "v").collect())
    want = []
    for g in ("a", "b", None):
        own = sorted((t, v) for x, t, v in rows if x == g)
        for k, (t, v) in enumerate(own):
            r = near[g, k]
            assert (r.t, r.v) == (t, v)
            for step, got in ((1, (r.t_1, r.v_1)), (3, (r.t_3, r.v_3)), (-2, (r.t_next2, r.v_next2))):
                assert got == (own[k - step] if 0 <= k - step < len(own) else (None, None))
        k = 0
        while k < len(own):
            n = next((j for j in range(k, len(own)) if own[j][1] != own[k][1]), len(own)) - k
            want.append((str(g), k, own[k][1], n))
            k += n
    assert found == sorted(want) and back == sorted((str(g), k, v) for (g, k), v in ((key, r.v) for key, r in near.items()))


def test_series_come_back(spark, points):
    assert {r.series for r in points.select("series").distinct().collect()} == {f"{m}{{host=h{h},zone=z}}" for m in ("cpu", "mem") for h in (0, 1)}
    encoded = codecs.encode_series(points, size=50)
    wrong = codecs.compare_series(points, codecs.decode_series(encoded, size=50)).agg(F.sum("lacking"), F.sum("wrong_times"), F.sum("wrong_values"), F.sum("points")).first()
    assert tuple(wrong) == (0, 0, 0, 400)
    odd = points.where("seq < 9").withColumn("value", F.expr("CASE seq WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') WHEN 3 THEN -0D ELSE value END"))
    assert {r.pattern for r in metrics.classify(odd).collect()} <= {"random", "sparse"}
    assert codecs.decode_series(codecs.encode_series(odd)).count() == 9 and codecs.encode_series(points.limit(0)).count() == 0


def test_rollups_are_stored(spark, points, tmp_path):
    codecs.store_rollups(points, str(tmp_path / "r"), (60, 600))
    got = sorted((r.interval_seconds, r.series, r.bucket, r.avg_value) for r in codecs.load_rollups(spark, str(tmp_path / "r")).collect())
    assert got == sorted((r.interval_seconds, r.series, r.bucket, r.avg_value) for r in metrics.rollup_multi(points, (60, 600)).collect())
    assert sorted(p.name for p in (tmp_path / "r").glob("interval*")) == ["interval_seconds=60", "interval_seconds=600"]


def test_negative_buckets_and_sparse_aggregates(spark):
    df = with_series(spark.createDataFrame([(k, k - 3, "m", {}, float(k)) for k in range(20)], "seq long, ts_s long, metric_name string, labels map<string,string>, value double"))
    assert {r.bucket: r.points for r in metrics.rollup(df, 5).collect()} == {-5: 3, 0: 5, 5: 5, 10: 5, 15: 2}
    r = metrics.rollup_full(df, seconds=100).where("bucket = 0").first()
    assert (r.p95, r.p99, r.middle, r.n) == (19.0, 19.0, 11.0, 17)
    one = metrics.rollup_full(df.limit(1), seconds=100).first()
    assert (one.middle, one.deviation, one.p95) == (None, None, None)


def test_strings_and_ids(spark, points):
    table = metrics.string_table(points)
    back = metrics.ids_to_strings(metrics.strings_to_ids(points.select("seq", "metric_name", "labels"), table), table)
    assert {r.seq: (r.metric_name, r.labels) for r in back.collect()} == {r.seq: (r.metric_name, r.labels) for r in points.collect()}
    catalog = metrics.series_catalog(points)
    held = metrics.with_series_id(points, catalog)
    assert metrics.id_differences(catalog, held).count() == 0
    assert [tuple(r) for r in metrics.id_differences(catalog.where("series_id <> 0"), held).collect()] == [("data", 0)]


def test_lines(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.log").write_text("one\n\n  two é \nthree\n")
    (tmp_path / "in" / "sub" / "b.log").write_text("four\n \t\nfive")
    lines = files.read_logs(spark, str(tmp_path / "in"))
    assert [(r.line_no, r.line) for r in lines.orderBy("line_no").collect()] == list(enumerate(["one", "", "  two é ", "three", "four", " \t", "five"]))
    clean = files.read_logs(spark, str(tmp_path / "in"), clean=True, most=4)
    assert [(r.line_no, r.line) for r in clean.orderBy("line_no").collect()] == list(enumerate(["one", "two é", "three", "four"]))
    assert logs.get_line(lines, 3) == "three" and [r.line for r in logs.line_range(lines, -2).orderBy("line_no").collect()] == [" \t", "five"] and logs.line_range(lines, 2, 2).count() == 0
    with pytest.raises(IndexError):
        logs.get_line(lines, 7)
    assert logs.byte_budget(lines, 5).count() == 2 and logs.byte_budget(lines, 4).count() == 1 and [r.line_no for r in logs.search(lines, "o").orderBy("line_no").collect()] == [0, 2, 4]
    files.write_text(lines, str(tmp_path / "out"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "out" / "text").glob("part*")))
    for r in spark.read.parquet(str(tmp_path / "out" / "index")).collect():
        assert raw[r.start_byte : r.start_byte + r.bytes].decode() == lines.where(F.col("line_no") == r.line_no).first().line + "\n"


def test_phases_are_stored(spark, points, tmp_path):
    lines = spark.createDataFrame([(k, f"user_{k % 3} took {k} ms at /a/{k % 2}") for k in range(50)], "line_no long, line string")
    e = templates.extract(lines)
    t = templates.dictionary(e)
    tagged = templates.with_template_id(e, t)
    order = logs.order_template(tagged)
    files.store_phase(str(tmp_path / "p"), templates=t, columns=log_columns.encode_variables(templates.variables(e)), order=logs.encode_order(order), lines=logs.to_zstd(lines, 16), series=codecs.encode_series(points))
    held = files.load_phase(spark, str(tmp_path / "p"), "templates", "columns", "order", "lines", "series")
    assert sorted(map(tuple, log_columns.decode_variables(held["columns"]).collect())) == sorted(map(tuple, templates.variables(e).collect()))
    assert sorted(map(tuple, logs.decode_order(held["order"]).collect())) == sorted((r.template_id, r.place, r.line_no) for r in order.collect())
    assert sorted(map(tuple, logs.from_zstd(held["lines"], 16).collect())) == sorted(map(tuple, lines.collect()))
    assert codecs.decode_series(held["series"]).count() == 400 and held["templates"].count() == 1


def test_typed_parts(spark):
    texts = ["10.0.0.1", "255.255.255.255", "256.0.0.1", "1.2.3", "01.2.3.4", "a.b.c.d", "", None, "1.2.3.4.5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", logs.ip_to_int(F.col("t")).alias("n"))
    assert {r.t: r.n for r in df.collect()} == dict.fromkeys(texts) | {"10.0.0.1": 167772161, "255.255.255.255": 4294967295}
    sizes = spark.range(1).select(*(files.size_text(F.lit(n)).alias(str(k)) for k, n in enumerate((5, 2048, 3 << 20, 5 << 30)))).first()
    assert tuple(sizes) == ("5 B", "2.0 KB", "3.0 MB", "5.0 GB")


def test_orders(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), ["IP"] * rng.randrange(3) + ["NUM"] * rng.randrange(2)) for k in range(500)]
    t = spark.createDataFrame(rows, "line_no long, template_id long, kinds array<string>")
    sig = lambda kinds: (f"{len(set(kinds)):03}|" + json.dumps([{"kind": k, "n": kinds.count(k)} for k in sorted(set(kinds))], separators=(",", ":")))
    want = {tid: [r[0] for r in sorted((r for r in rows if r[1] == tid), key=lambda r: (sig(r[2]), r[0]))] for tid in range(3)}
    for order in (logs.order_variables(t), logs.order_hybrid(t).drop("part")):
        assert {tid: [r.line_no for r in sorted(order.where(F.col("template_id") == tid).collect(), key=lambda r: r.place)] for tid in range(3)} == want
    back = logs.decode_order(logs.encode_order(logs.order_variables(t), size=64), size=64)
    assert sorted(map(tuple, back.collect())) == sorted((r.template_id, r.place, r.line_no) for r in logs.order_variables(t).collect())
    assert logs.order_is_dropped(logs.order_dropped(t)) and not logs.order_is_dropped(t)


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "trace_id long, span_no long, parent_no long, service_name string, operation_name string, start_time long, duration long, status_code int")


def test_deep_and_odd_traces(spark):
    """A chain of 3,000 spans, ties, zero durations, orphans, a trace without a root and one with a cycle."""
    rows = [(1, k, k - 1 if k > 1 else None, f"s{k // 1000}", "o", k, 1, 0) for k in range(1, 3001)]
    rows += [(2, 1, None, "r", "o", 0, 5, 0), (2, 2, 1, "first", "o", 1, 7, 1), (2, 3, 1, "second", "o", 2, 7, 1), (2, 4, 3, "zero", "o", 3, 0, 0), (2, 9, 8, "orphan", "o", 4, 99, 0)]
    rows += [(3, 1, 2, "x", "o", 0, 1, 0), (3, 2, 1, "y", "o", 1, 1, 0)]
    s = spans_of(spark, rows)
    got = {r.trace_id: r for r in traces.analyze(s).collect()}
    assert got[1].critical_total == 3000 and got[1].chain == ["s0", "s1", "s2", "s3"] and len(got[1].critical_path) == 3000 and got[1].repeated["s1:o"] == 1000
    assert (got[2].critical_total, got[2].critical_path, got[2].chain, got[2].fan_out, got[2].errors) == (12, ["r", "first"], ["r"], {"r": 2}, ["first", "second"])
    assert (got[3].critical_total, got[3].critical_path, got[3].chain) == (None, [], [])
    assert [(r.trace_id, r.span_no) for r in traces.orphan_spans(s).collect()] == [(2, 9)]
    assert [tuple(r) for r in traces.fan_out(s).collect()] == [(2, "r", 2)]
    again = traces.from_relationships(traces.relationships(s.where("trace_id = 1 OR trace_id = 2 AND span_no <> 9")), traces.trace_starts(s))
    assert columns.compare(s.where("trace_id = 1 OR trace_id = 2 AND span_no <> 9"), again, ("trace_id", "span_no")).agg(F.sum("wrong")).first()[0] == 0


def test_generators_and_sinks(spark, tmp_path):
    p = synthetic.points(spark, 20, 50)
    assert p.count() == 1000 and p.select("series").distinct().count() == 20 and sorted(map(str, p.collect())) == sorted(map(str, synthetic.points(spark, 20, 50).collect()))
    made = []
    read = lambda: files.cached(spark, str(tmp_path / "cache"), "small", "synthetic", lambda: made.append(1) or p)
    assert read().count() == read().count() == 1000 and made == [1]
    files.write_json_lines(p.select("ts_s", "metric_name", "value", "labels"), str(tmp_path / "json"))
    size = sum(f.stat().st_size for f in (tmp_path / "json").glob("part*"))
    assert files.json_size(p.select("ts_s", "metric_name", "value", "labels")).first().bytes == size
    t = synthetic.traces(spark, 60)
    files.write_traces(t, str(tmp_path / "traces"))
    back = files.read_traces(spark, str(tmp_path / "traces"))
    assert back.count() == t.count() and {(r.span_id, r.duration_ns, r.status) for r in back.collect()} == {(r.span_id, r.end_time - r.start_time, "ERROR" if r.status_code else "OK") for r in t.collect()}
    assert sorted(map(str, back.select(t.columns).collect())) == sorted(map(str, t.collect()))
    trained = codecs.train_dictionary(codecs.compact_spans(back))
    plain, small = (codecs.to_cbor(codecs.compact_spans(back), rows=8, level=3, dictionary=d).agg(F.sum(F.octet_length("payload"))).first()[0] for d in (None, trained))
    assert small < plain and len(trained) <= 1024
    schema = "t string, s string, p string, o string, svc string, st long, et long, d long, tags map<string,string>, logs array<struct<timestamp:bigint,level:string,message:string>>, sc int, stat string"
    again = codecs.from_cbor(codecs.to_cbor(codecs.compact_spans(back), level=3, dictionary=trained), schema, zstd=True, dictionary=trained)
    assert sorted(map(str, again.select("s", "p", "st", "sc", "tags", "logs").collect())) == sorted(map(str, back.select(F.col("span_id").alias("s"), F.col("parent_span_id").alias("p"), F.col("start_time").alias("st"), F.col("status_code").alias("sc"), "tags", "logs").collect()))
    assert [r.error_message for r in traces.first_error(back).where("status_code <> 0").limit(1).collect()][0].endswith("failed")


def test_wide_csv(spark, tmp_path):
    folder = tmp_path / "in" / "node-7"
    folder.mkdir(parents=True)
    (folder / "load.csv").write_text("timestamp,CPU Usage,Disk-read,note,Queue Count\n0,1.5,7,a,3\n30,,8,b,4\n60,inf,9,c,5\n")
    (tmp_path / "in" / "system-1.csv").write_text("timestamp,CPU Usage,Disk-read,note,Queue Count\n10,2.5,1,x,1\n")
    p = files.read_wide_csv(spark, str(tmp_path / "in"), now=1000)
    got = sorted((r.labels["host"], r.ts_s, r.metric_name, r.value) for r in p.where("metric_name <> 'timestamp_ms'").collect())
    want = [("node-7", 940, "cpu_usage_percent", 1.5), ("system-1", 1000, "cpu_usage_percent", 2.5), ("system-1", 1000, "disk_read_bytes", 1.0), ("system-1", 1000, "queue_count_total", 1.0)]
    want += [("node-7", 940 + 30 * k, "disk_read_bytes", 7.0 + k) for k in range(3)] + [("node-7", 940 + 30 * k, "queue_count_total", 3.0 + k) for k in range(3)]
    assert got == sorted(want) and all(set(r.labels) == {"host", "region", "environment", "source"} for r in p.collect())
    (tmp_path / "times").mkdir()
    (tmp_path / "times" / "a.csv").write_text("time,v\n2024-01-01 00:00:00,1\n2024-01-01 00:00:10,2\n")
    t0 = int(datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC).timestamp())
    assert sorted((r.ts_s, r.value) for r in files.read_wide_csv(spark, str(tmp_path / "times")).collect()) == [(t0, 1.0), (t0 + 10, 2.0)]
    (tmp_path / "clock").mkdir()
    (tmp_path / "clock" / "a.csv").write_text("label,v\nx,1\ny,2\n")
    assert sorted((r.ts_s, r.value) for r in files.read_wide_csv(spark, str(tmp_path / "clock"), now=100).collect()) == [(70, 1.0), (85, 2.0)]
    assert files.combined([p, p], most=5).count() == 5 and files.combined([p, p]).count() == p.count()
    names = {"Memory Used": "memory_used_percent", "memory bytes": "memory_bytes", "network-in": "network_in_bytes", "latency": "latency_ms", "total": "total", "errors count": "errors_count_total", "temp °C": "temp_c", "cpu percent": "cpu_percent"}
    assert {k: files.metric_name(k) for k in names} == names
