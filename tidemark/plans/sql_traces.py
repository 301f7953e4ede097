"""DuckDB forms of the queries over spans and traces."""

from __future__ import annotations

from .sql_views import query, spans

_T = "PARTITION BY trace_id ORDER BY start_time, span_no"
_PC = "pc AS (SELECT p.trace_id, p.span_no AS parent, p.service_name AS parent_service, c.span_no AS child, c.service_name AS child_service FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_no = p.span_no)"


def span_stats(x):
    return query(spans(x), select="SELECT count(*) AS spans, count(DISTINCT trace_id) AS traces, count(DISTINCT service_name) AS services, count(DISTINCT operation_name) AS operations, round(avg(CASE WHEN status_code <> 0 THEN 1e0 ELSE 0e0 END), 6) AS error_rate, round(avg(duration) / 1e6, 4) AS mean_ms FROM spans")


def top_services(x):
    return query(spans(x), select="SELECT service_name, count(*) AS spans FROM spans GROUP BY 1 ORDER BY spans DESC, service_name LIMIT 10")


def tag_domains(x):
    return query(spans(x), "t AS (SELECT 'service' AS k, service_name AS v FROM spans UNION ALL SELECT 'operation', operation_name FROM spans UNION ALL SELECT 'status', CAST(status_code AS VARCHAR(9)) FROM spans)",
                 select="SELECT k, count(DISTINCT v) AS domain, count(DISTINCT v) <= 10 AS mapped FROM t GROUP BY 1")


def call_graph(x):
    return query(spans(x), _PC, select="SELECT parent_service, child_service, count(*) AS calls FROM pc WHERE parent_service <> child_service GROUP BY 1, 2")


def topology_ids(x):
    return query(spans(x), "s AS (SELECT service_name, min(trace_id * 100 + span_no) AS f FROM spans GROUP BY 1)", select="SELECT service_name, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS service_id FROM s")


_REL = f"""i AS MATERIALIZED (SELECT *, row_number() OVER ({_T}) - 1 AS si, start_time - first_value(start_time) OVER ({_T}) AS std FROM spans),
  rel AS (SELECT c.trace_id, c.span_no, c.si, coalesce(p.si, -1) AS pi, c.service_name, c.operation_name, c.std, c.duration, c.status_code, c.start_time FROM i c LEFT JOIN i p ON c.trace_id = p.trace_id AND c.parent_no = p.span_no)"""


def span_relationships(x):
    return query(spans(x), _REL, select="SELECT trace_id, CAST(si AS BIGINT) AS si, CAST(pi AS BIGINT) AS pi, service_name, operation_name, std, duration, status_code FROM rel")


def relationship_roundtrip(x):
    return query(spans(x), select="SELECT trace_id, span_no, parent_no, service_name, operation_name, start_time, duration, status_code FROM spans")


def names_roundtrip(x):
    return query(spans(x), select="SELECT trace_id, span_no, service_name FROM spans")


def global_index(x):
    return query(spans(x), "g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY trace_id, start_time, span_no) - 1 AS gi FROM spans)",
                 select="SELECT c.trace_id, c.span_no, CAST(c.gi AS BIGINT) AS gi, CAST(coalesce(p.gi, -1) AS BIGINT) AS gp FROM g c LEFT JOIN g p ON c.trace_id = p.trace_id AND c.parent_no = p.span_no AND p.gi < c.gi")


def trace_presence(x):
    return "SELECT o_orderkey + 1 AS trace_id, o_orderkey + 1 IN (SELECT o_orderkey FROM orders) AS present FROM orders"


def tag_mapping(x):
    return query(spans(x), "t AS (SELECT DISTINCT 'operation' AS k, operation_name AS v FROM spans UNION SELECT DISTINCT 'status', CAST(status_code AS VARCHAR) FROM spans UNION SELECT DISTINCT 'service', service_name FROM spans)", "m AS (SELECT k FROM t GROUP BY 1 HAVING count(*) <= 10)",
                 select="SELECT k, v, CAST(dense_rank() OVER (ORDER BY k) - 1 AS BIGINT) AS key_id, CAST(row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS BIGINT) AS value_id FROM t WHERE k IN (SELECT k FROM m)")


def parent_deltas(x):
    return query(spans(x), _REL, select="SELECT trace_id, CAST(si AS BIGINT) AS si, CAST(CASE WHEN pi < 0 THEN -1 ELSE si - pi END AS BIGINT) AS parent_delta FROM rel")


def fan_out(x):
    return query(spans(x), _PC, "f AS (SELECT trace_id, parent, parent_service, count(*) AS n, count(DISTINCT child_service) AS d FROM pc GROUP BY 1, 2, 3)", select="SELECT trace_id, parent_service AS service_name, max_by(d, parent) AS services FROM f WHERE n > 1 AND d > 1 GROUP BY 1, 2")


def error_chain(x):
    return query(spans(x), select=f"SELECT trace_id, {x.joined('service_name', 'start_time, span_no')} AS services, count(*) AS errors FROM spans WHERE status_code <> 0 GROUP BY 1")


def repeated_ops(x):
    return query(spans(x), select="SELECT trace_id, service_name, operation_name, count(*) AS times FROM spans GROUP BY 1, 2, 3 HAVING count(*) > 1")


def leaf_spans(x):
    return query(spans(x), "u AS (SELECT DISTINCT trace_id AS t, parent_no AS p FROM spans WHERE parent_no IS NOT NULL)", select="SELECT trace_id, span_no, service_name FROM spans LEFT JOIN u ON trace_id = t AND span_no = p WHERE p IS NULL")


def orphan_spans(x):
    return query(spans(x), "u AS (SELECT trace_id AS t, span_no AS n FROM spans WHERE span_no <> 2)", select="SELECT trace_id, span_no, parent_no FROM spans LEFT JOIN u ON trace_id = t AND parent_no = n WHERE span_no <> 2 AND parent_no IS NOT NULL AND n IS NULL")


def critical_path(x):
    """All paths from the root to a leaf; of the longest, the one whose spans come first."""
    walk = """path AS (SELECT trace_id, span_no, duration AS total, service_name AS services, [span_no] AS places FROM spans WHERE parent_no IS NULL
      UNION ALL SELECT c.trace_id, c.span_no, p.total + c.duration, p.services || ',' || c.service_name, list_append(p.places, c.span_no) FROM path p JOIN spans c ON c.trace_id = p.trace_id AND c.parent_no = p.span_no)"""
    best = "r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total DESC, places) AS k FROM path)"
    return query(spans(x), walk, best, select="SELECT trace_id, total, services FROM r WHERE k = 1").replace("WITH ", "WITH RECURSIVE ", 1)


def service_chain(x):
    """From the root while a span has exactly one child; a service is named where it changes."""
    only = "single AS (SELECT trace_id, parent_no, max(span_no) AS child FROM spans WHERE parent_no IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)"
    walk = """chain AS (SELECT trace_id, span_no, service_name, service_name AS services, 1 AS depth FROM spans WHERE parent_no IS NULL
      UNION ALL SELECT c.trace_id, c.span_no, c.service_name, CASE WHEN c.service_name = p.service_name THEN p.services ELSE p.services || ',' || c.service_name END, p.depth + 1
      FROM chain p JOIN single s ON s.trace_id = p.trace_id AND s.parent_no = p.span_no JOIN spans c ON c.trace_id = s.trace_id AND c.span_no = s.child)"""
    return query(spans(x), only, walk, select="SELECT trace_id, max_by(services, depth) AS services FROM chain GROUP BY 1").replace("WITH ", "WITH RECURSIVE ", 1)


def trace_analysis(x):
    return query(spans(x), "e AS (SELECT trace_id, CAST(sum(CASE WHEN status_code <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM spans GROUP BY 1)", "r AS (SELECT trace_id, count(*) AS n FROM (SELECT trace_id, service_name, operation_name FROM spans GROUP BY 1, 2, 3 HAVING count(*) > 1) z GROUP BY 1)",
                 "pc AS (SELECT p.trace_id, p.span_no, p.service_name, count(*) AS n, count(DISTINCT c.service_name) AS d FROM spans c JOIN spans p ON c.trace_id = p.trace_id AND c.parent_no = p.span_no GROUP BY 1, 2, 3)", "f AS (SELECT trace_id, count(DISTINCT service_name) AS n FROM pc WHERE n > 1 AND d > 1 GROUP BY 1)",
                 select="SELECT e.trace_id, errors, coalesce(f.n, 0) AS fan_out, coalesce(r.n, 0) AS repeated FROM e LEFT JOIN r ON r.trace_id = e.trace_id LEFT JOIN f ON f.trace_id = e.trace_id")


def nested_traces(x):
    return query(spans(x), select="SELECT trace_id, count(*) AS n, CAST(sum(duration) AS BIGINT) AS total FROM spans GROUP BY 1")


def column_profile(x):
    of = lambda c: f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM spans"
    cols = " UNION ALL ".join(map(of, ("service_name", "operation_name", "start_time", "duration", "parent_no")))
    return query(spans(x), f"cols AS ({cols})", "pw AS (SELECT avg(CASE WHEN duration > 0 AND (duration & (duration - 1)) = 0 THEN 1e0 ELSE 0e0 END) AS share FROM spans)",
                 select="""SELECT c, count(*) AS total, count(DISTINCT v) AS levels, CAST(sum(CASE WHEN v IS NULL OR v = '' THEN 1 ELSE 0 END) AS BIGINT) AS nullish,
      CASE WHEN count(DISTINCT v) <= 10 THEN 'dictionary' WHEN c = 'duration' AND (SELECT share FROM pw) > 0.3 THEN 'power_of_2' WHEN c IN ('start_time', 'duration', 'parent_no') THEN 'delta' WHEN count(DISTINCT v) < 0.1 * count(*) THEN 'dictionary' ELSE 'run_length' END AS strategy FROM cols GROUP BY 1""")


def sorted_delta(x):
    return query(spans(x), select="SELECT service_name, trace_id, span_no, duration - lag(duration) OVER (PARTITION BY service_name ORDER BY duration, trace_id, span_no) AS delta, CAST(row_number() OVER (PARTITION BY service_name ORDER BY duration, trace_id, span_no) AS BIGINT) AS place FROM spans")


def status_rle(x):
    return query(spans(x), f"k AS (SELECT trace_id, status_code, row_number() OVER ({_T}) AS pos, row_number() OVER ({_T}) - row_number() OVER (PARTITION BY trace_id, status_code ORDER BY start_time, span_no) AS island FROM spans)",
                 select="SELECT trace_id, CAST(min(pos) - 1 AS BIGINT) AS start_pos, status_code, count(*) AS run_length FROM k GROUP BY trace_id, status_code, island")


def pow2_residual(x):
    return query(spans(x), "e AS (SELECT trace_id, span_no, duration, CAST(length(bin(duration)) - 1 AS INT) AS k FROM spans WHERE duration > 0)", "n AS (SELECT *, CASE WHEN duration - (CAST(1 AS BIGINT) << k) < (CAST(1 AS BIGINT) << (k + 1)) - duration THEN k ELSE k + 1 END AS e FROM e)",
                 select="SELECT trace_id, span_no, CAST(e AS BIGINT) AS exponent, duration - (CAST(1 AS BIGINT) << e) AS rest, abs(duration - (CAST(1 AS BIGINT) << e)) < 0.1 * (CAST(1 AS BIGINT) << e) AS near FROM n")


def span_columns(x):
    return query(spans(x), "g AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY trace_id, start_time, span_no) - 1 AS gi FROM spans)",
                 select="""SELECT c.trace_id, CAST(c.gi AS BIGINT) AS span_index, CAST(coalesce(p.gi, -1) AS BIGINT) AS parent_index, c.service_name, c.operation_name, c.start_time, c.start_time + c.duration AS end_time, c.duration, c.status_code,
      'operation' AS tag_keys, c.operation_name AS tag_values, CAST(CASE WHEN c.status_code <> 0 THEN 2 ELSE 1 END AS BIGINT) AS log_count, CASE WHEN c.status_code <> 0 THEN c.service_name || ' failed' ELSE '' END AS error_message
      FROM g c LEFT JOIN g p ON c.trace_id = p.trace_id AND c.parent_no = p.span_no AND p.gi < c.gi""")


def trace_columns_roundtrip(x):
    return query(spans(x), _REL, select="SELECT trace_id, CAST(si AS BIGINT) AS si, CAST(pi AS BIGINT) AS pi, service_name, operation_name, std, duration, CAST(status_code AS BIGINT) AS status_code FROM rel")


def columns_compare(x):
    return "SELECT unnest(['pi', 'service_name', 'operation_name', 'std', 'duration', 'status_code']) AS name, 0 AS wrong"


def cbor_spans(x):
    return query(spans(x), select="SELECT trace_id, span_no, service_name, operation_name, start_time, duration, status_code FROM spans")


def span_status_text(x):
    return query(spans(x), select="SELECT trace_id, span_no, duration AS duration_ns, CASE WHEN status_code = 0 THEN 'OK' ELSE 'ERROR' END AS status FROM spans")


QUERIES = {f.__name__: f for f in (span_stats, top_services, tag_domains, tag_mapping, call_graph, topology_ids, names_roundtrip, span_relationships, relationship_roundtrip, parent_deltas, global_index, trace_presence, fan_out, error_chain, repeated_ops, leaf_spans, orphan_spans, critical_path,
                                   service_chain, trace_analysis, nested_traces, column_profile, sorted_delta, status_rle, pow2_residual, span_columns, trace_columns_roundtrip, columns_compare, cbor_spans, span_status_text)}
