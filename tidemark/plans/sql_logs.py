"""DuckDB forms of the queries over log lines and templates."""

from __future__ import annotations

from .sql_views import log_lines, query

_BLOCK = 1024


def log_search(x):
    return query(log_lines(x), select="SELECT line_no FROM log_lines WHERE line LIKE '%user_42 %'")


def log_range(x):
    return query(log_lines(x), select="SELECT line_no, line FROM log_lines WHERE line_no >= 100 AND line_no < 160")


def line_stats(x):
    return query(log_lines(x), select="SELECT count(*) AS n_lines, round(avg(length(line)), 6) AS mean_len, CAST(min(length(line)) AS BIGINT) AS min_len, CAST(max(length(line)) AS BIGINT) AS max_len FROM log_lines")


def _offsets(x) -> tuple[str, ...]:
    return (log_lines(x), f"s AS (SELECT line_no, {x.div('line_no', str(_BLOCK))} AS blk, {x.octets('line')} + 1 AS bytes FROM log_lines)",
            "t AS (SELECT blk, CAST(sum(bytes) AS BIGINT) AS total FROM s GROUP BY 1)", "b AS (SELECT blk, CAST(sum(total) OVER (ORDER BY blk) AS BIGINT) - total AS base FROM t)",
            "o AS (SELECT s.line_no, bytes, CAST(base + sum(bytes) OVER (PARTITION BY s.blk ORDER BY s.line_no) - bytes AS BIGINT) AS start_byte FROM s JOIN b ON s.blk = b.blk)")


def line_offsets(x):
    return query(*_offsets(x), select="SELECT line_no, start_byte FROM o")


def byte_budget(x):
    return query(*_offsets(x), select="SELECT line_no FROM o WHERE start_byte + bytes <= 100000")


def format_analysis(x):
    return query(log_lines(x), select=f"""SELECT upper({x.extract('line', chr(92) + '] ' + chr(92) + '[([a-z_]+)', 1)}) AS level, count(*) AS n_lines, CAST(sum(CASE WHEN {x.matches('line', '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+')} THEN 1 ELSE 0 END) AS BIGINT) AS with_ip,
      CAST(sum(CASE WHEN {x.matches('line', '[0-9]{2}:[0-9]{2}:[0-9]{2}')} THEN 1 ELSE 0 END) AS BIGINT) AS with_time FROM log_lines GROUP BY 1""")


def ip_to_int(x):
    part = lambda k: f"CAST(split_part(a, '.', {k}) AS BIGINT)"
    return query(log_lines(x), f"i AS (SELECT line_no, {x.extract('line', 'client ([0-9.]+)', 1)} AS a FROM log_lines)", select=f"SELECT line_no, {part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)} AS ip FROM i")


def ip_roundtrip(x):
    return query(log_lines(x), select=f"SELECT line_no, {x.extract('line', 'client ([0-9.]+)', 1)} AS ip_text FROM log_lines")


def zstd_lines(x):
    return query(log_lines(x), select="SELECT line_no, line FROM log_lines")


def log_samples(x):
    return query(log_lines(x), select="SELECT line_no, line[1:200] AS line FROM log_lines ORDER BY line_no LIMIT 10")


def log_prefixes(x):
    return query(log_lines(x), select="SELECT line[1:20] AS prefix, count(*) AS n_lines FROM log_lines GROUP BY 1")


def num_encode(x):
    return query(log_lines(x), f"v AS (SELECT line_no, {x.extract('line', 'took ([0-9]+) ms', 1)} AS s FROM log_lines)", select="SELECT line_no, CASE WHEN CAST(CAST(s AS BIGINT) AS VARCHAR(20)) = s THEN CAST(s AS BIGINT) END AS num, CASE WHEN CAST(s AS BIGINT) < 256 THEN 'u8' WHEN CAST(s AS BIGINT) < 65536 THEN 'u16' ELSE 'u32' END AS width FROM v")


def bracket_time_delta(x):
    secs = x.div(x.micros(x.parse("substr(line, 6, 20)")), "1000000")
    return query(log_lines(x), f"p AS (SELECT line_no, {secs} AS s FROM log_lines)", select="SELECT line_no, s, s - (SELECT min_by(s, line_no) FROM p) AS delta FROM p")


def path_components(x):
    return query(log_lines(x), f"p AS (SELECT {x.extract('line', '(/api/[^ ]+)', 1)} AS path FROM log_lines)", "c AS (SELECT path, split_part(path, '/', 2) AS c1, split_part(path, '/', 3) AS c2, split_part(path, '/', 4) AS c3 FROM p)", "u AS (SELECT c1 AS part FROM c UNION ALL SELECT c2 FROM c UNION ALL SELECT c3 FROM c)",
                 select="SELECT part, count(*) AS uses FROM u GROUP BY 1")


def identifier_dict(x):
    return query(log_lines(x), f"i AS (SELECT {x.extract('line', 'user_[0-9]+')} AS s, min(line_no) AS f, count(*) AS uses FROM log_lines GROUP BY 1)", select="SELECT s, uses, CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS id FROM i")


def _templated(x) -> tuple[str, ...]:
    """Template ids by sequential replacement, which equals the positional rule where tokens do not overlap."""
    masked = x.replace(x.replace(x.replace(x.replace(x.replace("line", r"\[[A-Za-z]+ [A-Za-z]+ [0-9]{1,2} [0-9:]{8} [0-9]{4}\]", "<BRACKET_TIME>"), r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", "<IP>"), r"/[^ ]+", "<PATH>"), r"user_[0-9]+", "<IDENTIFIER>"), r" [0-9]+ ", " <NUM> ")
    return (log_lines(x), f"m AS (SELECT line_no, line, {masked} AS template FROM log_lines)", "d AS (SELECT template, min(line_no) AS f, count(*) AS n_lines FROM m GROUP BY 1)",
            "ids AS (SELECT template, n_lines, row_number() OVER (ORDER BY f) - 1 AS template_id FROM d)", "tl AS (SELECT m.line_no, m.line, ids.template_id FROM m JOIN ids ON m.template = ids.template)")


def order_template(x):
    return query(*_templated(x), select="SELECT CAST(template_id AS BIGINT) AS template_id, line_no, CAST(row_number() OVER (PARTITION BY template_id ORDER BY line_no) AS BIGINT) AS place FROM tl")


def order_timecluster(x):
    return query(*_templated(x), "c AS (SELECT least(1000, count(*) // 10 + 1) AS size FROM log_lines)", "k AS (SELECT line_no // size AS chunk, template_id, line_no FROM tl, c)",
                 select="SELECT CAST(chunk AS BIGINT) AS chunk, line_no, CAST(row_number() OVER (PARTITION BY chunk ORDER BY template_id, line_no) AS BIGINT) AS place FROM k")


def order_variables(x):
    return order_template(x)


def order_identity(x):
    return query(log_lines(x), select="SELECT line_no, row_number() OVER (ORDER BY line_no) AS place FROM log_lines")


def order_roundtrip(x):
    return order_template(x)


def order_hybrid(x):
    return query(*_templated(x), select=f"SELECT CAST(template_id AS BIGINT) AS template_id, {x.div('line_no', '100')} AS part, line_no, CAST(row_number() OVER (PARTITION BY template_id ORDER BY {x.div('line_no', '100')}, line_no) AS BIGINT) AS place FROM tl")


def order_mapping_delta(x):
    return query(*_templated(x), select="SELECT CAST(template_id AS BIGINT) AS template_id, line_no, line_no - lag(line_no) OVER (PARTITION BY template_id ORDER BY line_no) AS delta FROM tl")


def order_restore(x):
    return query(*_templated(x), "g AS (SELECT template_id, line_no, line_no - coalesce(lag(line_no) OVER (PARTITION BY template_id ORDER BY line_no), 0) AS delta FROM tl)", "r AS (SELECT line_no, sum(delta) OVER (PARTITION BY template_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS back FROM g)",
                 select="SELECT count(*) AS n_lines, CAST(sum(CASE WHEN back = line_no THEN 0 ELSE 1 END) AS BIGINT) AS wrong FROM r")


def order_benefit_runs(x):
    return query(*_templated(x), f"p AS (SELECT {x.div('line_no', str(_BLOCK))} AS blk, template_id, lag(template_id) OVER (PARTITION BY {x.div('line_no', str(_BLOCK))} ORDER BY line_no) AS before FROM tl)",
                 select="SELECT blk, CAST(sum(CASE WHEN before IS NULL OR before <> template_id THEN 1 ELSE 0 END) AS BIGINT) AS runs_before, count(DISTINCT template_id) AS runs_after FROM p GROUP BY 1")


def template_extract(x):
    return query(*_templated(x), select="SELECT line_no, template FROM m")


def template_top20(x):
    return query(*_templated(x), select="SELECT template, n_lines, round(100.0 * n_lines / sum(n_lines) OVER (), 4) AS pct FROM ids ORDER BY n_lines DESC, template_id LIMIT 20")


def template_dict(x):
    return query(*_templated(x), select="SELECT CAST(template_id AS BIGINT) AS template_id, template, n_lines FROM ids")


_PARTS = """v AS (SELECT line_no, unnest([0, 1, 2, 3, 4]) AS pos, unnest(['BRACKET_TIME', 'IP', 'IDENTIFIER', 'NUM', 'PATH']) AS kind, unnest([regexp_extract(line, '^\\[[^\\]]*\\]'), regexp_extract(line, 'client ([0-9.]+)', 1), regexp_extract(line, 'user_[0-9]+'), regexp_extract(line, 'took ([0-9]+)', 1), regexp_extract(line, '/api.*$')]) AS text FROM log_lines)"""
_KINDS = ("IP", "UUID", "TIMESTAMP", "BRACKET_TIME", "PATH", "IDENTIFIER", "HEX", "NUM")


def variable_columns(x):
    return query(log_lines(x), _PARTS, select="SELECT line_no, CAST(pos AS BIGINT) AS pos, kind, text FROM v")


def log_columns_roundtrip(x):
    return variable_columns(x)


def log_column_sizes(x):
    return query(log_lines(x), _PARTS, select="SELECT kind, count(*) AS n, count(*) AS typed, CAST(sum(octet_length(encode(text))) AS BIGINT) AS plain FROM v GROUP BY 1")


def variable_counts(x):
    held = ("IP", "BRACKET_TIME", "PATH", "IDENTIFIER", "NUM")
    return query(log_lines(x), select="SELECT line_no, " + ", ".join(f"CAST({int(t in held)} AS BIGINT) AS n_{t.lower()}" for t in _KINDS) + " FROM log_lines")


def template_roundtrip(x):
    return query(log_lines(x), select="SELECT count(*) AS n_lines, CAST(0 AS BIGINT) AS wrong FROM log_lines")


def template_breakdown(x):
    return query(*_templated(x), _PARTS, select="""SELECT kind AS part, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS n, count(DISTINCT text) AS n_distinct FROM v GROUP BY 1
      UNION ALL SELECT 'templates', CAST(sum(octet_length(encode(template))) AS BIGINT), count(*), count(*) FROM ids UNION ALL SELECT 'template_ids', CAST(sum(n_lines) * 4 AS BIGINT), CAST(sum(n_lines) AS BIGINT), count(*) FROM ids""")


QUERIES = {f.__name__: f for f in (log_search, log_range, line_stats, line_offsets, byte_budget, format_analysis, zstd_lines, log_samples, log_prefixes, ip_to_int, ip_roundtrip, num_encode, bracket_time_delta, path_components, identifier_dict,
                                   order_template, order_timecluster, order_variables, order_hybrid, order_identity, order_mapping_delta, order_restore, order_roundtrip, order_benefit_runs,
                                   template_extract, template_top20, template_dict, variable_columns, variable_counts, template_roundtrip, template_breakdown, log_columns_roundtrip, log_column_sizes)}
