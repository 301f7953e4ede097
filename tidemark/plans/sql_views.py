"""Points, spans and log lines as common table expressions of DuckDB over the driver's tables."""

from __future__ import annotations

import textwrap


def metric_points(x) -> str:
    return f"""metric_points AS (SELECT event_id AS seq, {x.div(x.micros('ts'), '1000000')} AS ts_s, concat(event_type, '_value') AS metric_name, value,
      concat('r', user_id % 3) AS region, concat(event_type, '_value{{region=r', user_id % 3, '}}') AS series FROM {x.t('events')})"""


def spans(x) -> str:
    return f"""li AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) + 1 AS n FROM {x.t('lineitem')} l),
    sp AS (SELECT o_orderkey AS trace_id, CAST(1 AS BIGINT) AS n, 'api-gateway' AS service_name, 'route' AS operation_name, {x.micros('o_orderdate')} * 1000 AS start_time,
      CAST(round(o_totalprice * 100) AS BIGINT) * 1000 AS duration, CAST(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS INT) AS status_code FROM {x.t('orders')}
      UNION ALL SELECT o_orderkey, CAST(n AS BIGINT), concat('svc-', l_suppkey % 12), concat(l_returnflag, l_linestatus), {x.micros('o_orderdate')} * 1000 + n * 1000000,
      CAST(round(l_extendedprice * 100) AS BIGINT) * 1000, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) FROM li JOIN {x.t('orders')} ON l_orderkey = o_orderkey),
    spans AS MATERIALIZED (SELECT trace_id, n AS span_no, CASE WHEN n > 1 THEN {x.div('n', '2')} END AS parent_no, service_name, operation_name, start_time, duration, status_code FROM sp)"""


def log_lines(x) -> str:
    return f"""log_lines AS (SELECT event_id AS line_no, concat('[', {x.stamp('ts')}, '] [', event_type, '] [client 10.', user_id % 256, '.', event_id % 256, '.7] user_', user_id, ' took ', CAST(floor(value) AS BIGINT),
      ' ms ', '/api/v', user_id % 3, '/', event_type) AS line FROM {x.t('events')})"""


def query(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + textwrap.dedent(select).strip()
