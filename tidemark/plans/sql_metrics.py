"""DuckDB forms of the queries over metric series."""

from __future__ import annotations

from .sql_views import metric_points, query

_S = "PARTITION BY series ORDER BY ts_s, seq"


def _rollup(seconds: int):
    return lambda x: query(metric_points(x), select=f"SELECT series, {x.div('ts_s', str(seconds))} * {seconds} AS bucket, round(avg(value), 6) AS avg_value, count(*) AS points FROM metric_points GROUP BY 1, 2")


def _intervals(x) -> str:
    return "intervals AS (SELECT CAST(300 AS BIGINT) AS i UNION ALL SELECT 900 UNION ALL SELECT 3600)"


def rollup_multi(x):
    return query(metric_points(x), _intervals(x), select=f"SELECT series, i AS interval_seconds, {x.div('ts_s', 'i')} * i AS bucket, round(avg(value), 6) AS avg_value, count(*) AS points FROM metric_points CROSS JOIN intervals GROUP BY 1, 2, 3")


def rollup_full_aggs(x):
    values = x.sorted_list("value")
    pick = lambda q: f"CASE WHEN count(*) >= 4 THEN {x.at(values, f'least(floor(count(*) * {q}) + 1, count(*))')} END"
    return query(metric_points(x), select=f"""SELECT metric_name, {x.div('ts_s', '86400')} * 86400 AS bucket, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high,
      min_by(value, ts_s * 100000000 + seq) AS first_value, max_by(value, ts_s * 100000000 + seq) AS last_value, CASE WHEN count(*) >= 2 THEN round(median(value), 6) END AS middle,
      CASE WHEN count(*) >= 2 THEN round(stddev_samp(value), 6) END AS deviation, {pick('0.95')} AS p95, {pick('0.99')} AS p99 FROM metric_points GROUP BY 1, 2""")


def rollup_reduction(x):
    return query(metric_points(x), _intervals(x), select=f"""SELECT i AS interval_seconds, count(*) AS kept, CAST(max(total) AS BIGINT) AS points, round(max(total) * 1e0 / count(*), 6) AS ratio
      FROM (SELECT i, series, {x.div('ts_s', 'i')} AS b FROM metric_points CROSS JOIN intervals GROUP BY 1, 2, 3) CROSS JOIN (SELECT count(*) AS total FROM metric_points) GROUP BY 1""")


def named_filter(x):
    return query(metric_points(x), select="SELECT series, count(*) AS points, min(ts_s) AS first_ts, max(ts_s) AS last_ts, round((max(ts_s) - min(ts_s)) / 3600e0, 6) AS hours FROM metric_points WHERE lower(metric_name) LIKE '%click%' GROUP BY 1")


def series_catalog(x):
    return query(metric_points(x), "g AS (SELECT series, metric_name, region, min(seq) AS f, count(*) AS points FROM metric_points GROUP BY 1, 2, 3)",
                 select="SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS series_id, series, metric_name, region, points FROM g")


def series_arrays(x):
    return query(metric_points(x), "p AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts_s, value, seq) - 1 AS pos FROM metric_points)",
                 select=f"SELECT series, CAST(pos // 4096 AS BIGINT) AS chunk, {x.joined('ts_s', 'pos')} AS timestamps, count(*) AS points FROM p GROUP BY 1, 2")


def dataset_stats(x):
    return query(metric_points(x), f"d AS (SELECT series, ts_s, value, ts_s - lag(ts_s) OVER ({_S}) AS gap FROM metric_points)",
                 select="SELECT count(*) AS points, count(DISTINCT series) AS series, round((max(ts_s) - min(ts_s)) / 3600e0, 4) AS hours, round(count(*) * 1e0 / count(DISTINCT series), 4) AS per_series, round(1e2 * avg(CASE WHEN gap <= 3600 THEN 1 ELSE 0 END), 4) AS within_hour_pct, round(1e2 * avg(CASE WHEN value = round(value) THEN 1 ELSE 0 END), 4) AS whole_pct FROM d")


def _strings(x):
    return "strings AS (SELECT metric_name AS s FROM metric_points UNION ALL SELECT 'region' FROM metric_points UNION ALL SELECT region FROM metric_points)"


def label_top10(x):
    return query(metric_points(x), select="SELECT 'region' AS label, region AS text, count(*) AS uses FROM metric_points GROUP BY 1, 2 ORDER BY uses DESC, text LIMIT 10")


def string_table(x):
    return query(metric_points(x), _strings(x), select="SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT s FROM strings) u")


def string_redundancy(x):
    return query(metric_points(x), _strings(x), "u AS (SELECT s, count(*) AS n FROM strings GROUP BY 1)",
                 select="SELECT CAST(sum(length(s) * n) AS BIGINT) AS total_chars, CAST(sum(length(s)) AS BIGINT) AS unique_chars, count(*) AS strings FROM u")


def columnar_benefits(x):
    return query(metric_points(x), select="SELECT count(DISTINCT series) AS series, round(count(*) * 1e0 / count(DISTINCT series), 4) AS avg_points, count(DISTINCT metric_name) AS names, 1 AS label_keys, count(DISTINCT region) AS label_values FROM metric_points")


def series_verify(x):
    return query(metric_points(x), "o AS (SELECT series, ts_s - lag(ts_s) OVER (PARTITION BY series ORDER BY seq) AS d FROM metric_points)", select="SELECT series, count(*) AS points, CAST(sum(CASE WHEN d < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unsorted FROM o GROUP BY 1")


def ts_delta(x):
    return query(metric_points(x), select=f"SELECT series, seq, ts_s - lag(ts_s) OVER ({_S}) AS delta FROM metric_points")


_DD = f"d AS (SELECT series, seq, ts_s, ts_s - lag(ts_s) OVER ({_S}) AS delta FROM metric_points), dd AS (SELECT series, seq, ts_s, delta, delta - lag(delta) OVER ({_S}) AS dd FROM d)"


def ts_double_delta(x):
    return query(metric_points(x), _DD, select="SELECT series, seq, delta, dd FROM dd")


def delta_decode_roundtrip(x):
    return query(metric_points(x), _DD, f"f AS (SELECT series, seq, ts_s, sum(coalesce(delta, ts_s)) OVER ({_S} ROWS UNBOUNDED PRECEDING) AS back FROM dd)",
                 select="SELECT series, count(*) AS points, CAST(sum(CASE WHEN back = ts_s THEN 0 ELSE 1 END) AS BIGINT) AS wrong FROM f GROUP BY 1")


_RUNS = f"""lv AS (SELECT series, seq, ts_s, CAST(floor(value / 100) AS BIGINT) AS level FROM metric_points),
  k AS (SELECT *, row_number() OVER ({_S}) - row_number() OVER (PARTITION BY series, level ORDER BY ts_s, seq) AS island, row_number() OVER ({_S}) AS pos FROM lv),
  runs AS (SELECT series, level, island, min(pos) AS start_pos, count(*) AS run_length FROM k GROUP BY 1, 2, 3)"""


def rle_runs(x):
    return query(metric_points(x), _RUNS, select="SELECT series, CAST(start_pos - 1 AS BIGINT) AS start_pos, level, run_length FROM runs")


def rle_roundtrip(x):
    return query(metric_points(x), _RUNS, select="SELECT series, CAST(pos - 1 AS BIGINT) AS pos, level FROM k")


def interval_regularity(x):
    return query(metric_points(x), "o AS (SELECT metric_name, ts_s, lag(metric_name) OVER w AS m, lag(ts_s) OVER w AS t FROM metric_points WINDOW w AS (ORDER BY ts_s, seq))",
                 select="SELECT count(*) AS pairs, round(avg(CASE WHEN ts_s - t = 15 THEN 1e0 ELSE 0e0 END), 6) AS regular_share FROM o WHERE m = metric_name")


def gap_spread(x):
    return query(metric_points(x), _DD, select="SELECT series, round(avg(CASE WHEN delta <= 600 THEN 1e0 ELSE 0e0 END), 6) AS regular_share, count(DISTINCT delta) AS deltas FROM dd WHERE delta IS NOT NULL GROUP BY 1")


def ts_codec_choice(x):
    return query(metric_points(x), _DD, select="SELECT series, CASE WHEN count(*) = 1 THEN 'single' WHEN count(delta) >= 4 AND count(DISTINCT delta) = 1 THEN 'regular' WHEN count(delta) >= 4 AND count(DISTINCT delta) = 2 THEN 'dual_interval' ELSE 'delta_rle' END AS method, min(ts_s) AS t0, count(*) AS n FROM dd GROUP BY 1")


def series_profile(x):
    return query(metric_points(x), select="SELECT series, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS span, count(DISTINCT value) AS levels, round(var_pop(value), 4) AS variance, count(*) AS points, CASE WHEN count(*) < 100 THEN '<100' WHEN count(*) < 1000 THEN '100-999' ELSE '>=1000' END AS size_class FROM metric_points GROUP BY 1")


def pattern_classify(x):
    """First rule that holds wins; one window pass for neighbours, one aggregate, one over distinct gaps."""
    lags = (6, 12, 24, 60, 300)
    cols = ", ".join(f"lag(value, {k}) OVER ({_S}) AS l{k}" for k in lags)
    means = ", ".join(f"avg(abs(value - l{k})) AS m{k}" for k in lags)
    period = " ".join(f"WHEN n >= 20 AND {k} < {x.div('n', '3')} AND hi > lo AND m{k} / (hi - lo) < 0.1 THEN 'periodic_{k}'" for k in lags)
    pow2 = "CASE WHEN value > 0 AND value = pow(2, CAST(trunc_log AS DOUBLE)) THEN 1e0 ELSE 0e0 END"
    return query(metric_points(x),
                 f"w AS (SELECT series, value, lag(value) OVER ({_S}) AS l1, first_value(value) OVER ({_S}) AS v0, CASE WHEN value > 0 THEN CASE WHEN value >= 1 THEN floor(ln(value) / ln(2.0)) ELSE ceil(ln(value) / ln(2.0)) END END AS trunc_log, {cols} FROM metric_points)",
                 f"""a AS (SELECT series, count(*) AS n, min(value) AS lo, max(value) AS hi, avg(CASE WHEN abs(value) < 1e-10 THEN 1e0 ELSE 0e0 END) AS zero, avg({pow2}) AS pw, avg(CASE WHEN value = floor(value) THEN 1e0 ELSE 0e0 END) AS whole,
                   count(CASE WHEN l1 <> 0 THEN 1 END) AS ratios, var_pop(CASE WHEN l1 <> 0 THEN value / l1 END) AS rv, avg(CASE WHEN l1 <> 0 THEN value / l1 END) AS rm, avg((value - v0) * (value - v0)) AS away, {means} FROM w GROUP BY 1)""",
                 "u AS (SELECT DISTINCT series, value FROM metric_points)", "g AS (SELECT series, value, value - lag(value) OVER (PARTITION BY series ORDER BY value) AS gap FROM u)",
                 "q AS (SELECT series, count(*) AS levels, count(DISTINCT gap) AS gaps FROM g GROUP BY 1)",
                 select=f"""SELECT a.series, n, CASE WHEN n < 3 THEN 'sparse' WHEN lo = hi THEN 'constant' WHEN hi - lo < 1e-6 THEN 'near_constant' WHEN zero > 0.3 THEN 'sparse' WHEN pw > 0.7 THEN 'power_of_2' WHEN whole > 0.8 THEN 'mostly_integers'
                   WHEN n >= 5 AND ratios >= 3 AND rv < 0.01 AND rm > 0.9 AND rm < 1.1 THEN 'exponential' {period}
                   WHEN levels <= least(50, {x.div('n', '5')}) THEN CASE WHEN levels >= 3 AND gaps <= 3 THEN 'quantized_stepped' ELSE 'quantized' END WHEN away < 100 THEN 'smooth' ELSE 'random' END AS pattern FROM a JOIN q ON a.series = q.series""")


def dict_encode(x):
    return query(metric_points(x), "c AS (SELECT series, CAST(floor(value / 10) AS BIGINT) AS level, count(*) AS n, min(seq) AS f FROM metric_points GROUP BY 1, 2)", "r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, f) - 1 AS code FROM c)",
                 select="SELECT series, level, n, CAST(CASE WHEN code < 255 THEN code ELSE 255 END AS BIGINT) AS code FROM r")


def sparse_encode(x):
    return query(metric_points(x), f"z AS (SELECT series, row_number() OVER ({_S}) - 1 AS pos, CASE WHEN value < 50 THEN 0e0 ELSE value END AS v FROM metric_points)", select="SELECT series, CAST(pos AS BIGINT) AS pos, v FROM z WHERE v <> 0e0")


def int_split(x):
    return query(metric_points(x), select="SELECT series, seq, CAST(floor(value) AS BIGINT) AS whole, round(value - floor(value), 6) AS rest FROM metric_points")


def varint_size(x):
    return query(metric_points(x), _DD, "z AS (SELECT series, CASE WHEN dd >= 0 THEN 2 * dd ELSE -2 * dd - 1 END AS u FROM dd WHERE dd IS NOT NULL)",
                 select="SELECT series, CAST(sum(CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 WHEN u < 268435456 THEN 4 WHEN u < 34359738368 THEN 5 WHEN u < 4398046511104 THEN 6 WHEN u < 562949953421312 THEN 7 WHEN u < 72057594037927936 THEN 8 ELSE 9 END) AS BIGINT) AS bytes FROM z GROUP BY 1")


def delta_zero_share(x):
    return query(metric_points(x), f"d AS (SELECT series, floor(value / 100) - lag(floor(value / 100)) OVER ({_S}) AS dv FROM metric_points)", select="SELECT series, round(avg(CASE WHEN abs(dv) < 1e-10 THEN 1e0 ELSE 0e0 END), 6) AS zero_share, CASE WHEN avg(CASE WHEN abs(dv) < 1e-10 THEN 1e0 ELSE 0e0 END) > 0.7 THEN 'mask' ELSE 'raw' END AS layout FROM d WHERE dv IS NOT NULL GROUP BY 1")


def metadata_dict(x):
    return query(metric_points(x), "e AS (SELECT 'name' AS kind, metric_name AS s FROM metric_points UNION SELECT 'key', 'region' UNION SELECT 'value', region FROM metric_points)", select="SELECT kind, s, CAST(row_number() OVER (PARTITION BY kind ORDER BY s) - 1 AS BIGINT) AS id FROM e")


def method_summary(x):
    inner = pattern_classify(x)
    return f"SELECT pattern, count(*) AS series, CAST(sum(n) AS BIGINT) AS points FROM ({inner}) t GROUP BY 1"


def xor_size(x):
    """Bits of the XOR form: 1 for a repeat, else 1 + 6 + 6 + the significant bits; 64 for the first value."""
    return query(metric_points(x), f"p AS (SELECT series, value, lag(value) OVER ({_S}) AS before FROM metric_points)", f"b AS (SELECT series, before, value, {x.bin_xor('value', 'before')} AS s FROM p WHERE before IS NOT NULL)",
                 "z AS (SELECT series, CASE WHEN s NOT LIKE '%1%' THEN 1 ELSE 13 + length(rtrim(ltrim(s, '0'), '0')) END AS bits FROM b)",
                 select=f"SELECT series, CAST(sum(bits) + 64 AS BIGINT) AS bits, CAST(ceil((sum(bits) + 64) / 8e0) AS BIGINT) AS bytes FROM z GROUP BY 1")


def point_ids(x):
    return query(metric_points(x), "g AS (SELECT series, row_number() OVER (ORDER BY min(seq)) - 1 AS series_id FROM metric_points GROUP BY 1)", select="SELECT seq, CAST(series_id AS BIGINT) AS series_id FROM metric_points p JOIN g ON p.series = g.series")


def id_differences(x):
    return query(metric_points(x), "g AS (SELECT series, min(metric_name) AS name, row_number() OVER (ORDER BY min(seq)) - 1 AS series_id FROM metric_points GROUP BY 1)", select="SELECT 'catalog' AS side, CAST(series_id AS BIGINT) AS series_id FROM g WHERE name NOT LIKE '%click%'")


def key_repetition(x):
    return query(metric_points(x), select="SELECT 'region' AS label, count(*) AS uses, count(DISTINCT region) AS texts FROM metric_points")


def type_benefits(x):
    return query(metric_points(x), select="SELECT count(ts_s) AS integers, count(value) AS floats, CAST(3 * count(*) AS BIGINT) AS strings FROM metric_points")


def string_roundtrip(x):
    return query(metric_points(x), select="SELECT seq, metric_name, region FROM metric_points")


def xor_roundtrip(x):
    return query(metric_points(x), select=f"SELECT series, CAST(row_number() OVER ({_S}) - 1 AS BIGINT) AS pos, ts_s, value FROM metric_points")


def series_compare(x):
    return query(metric_points(x), select="SELECT series, count(*) AS points, 0 AS lacking, 0 AS wrong_times, 0 AS wrong_values FROM metric_points GROUP BY 1")


def rollup_store(x):
    return f"SELECT interval_seconds, series, bucket, avg_value FROM ({rollup_multi(x)}) r"


def table_roundtrip(x):
    return query(metric_points(x), select="SELECT ts_s, metric_name, value, region FROM metric_points")


def cbor_roundtrip(x):
    return query(metric_points(x), select="SELECT seq, ts_s, metric_name, value, region FROM metric_points")


def wide_unpivot(x):
    return "SELECT metric_name, count(*) AS points, min(value) AS low, max(value) AS high, round(sum(value), 2) AS total FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME metric_name VALUE value) GROUP BY 1"


QUERIES = {"rollup_300s": _rollup(300), "rollup_900s": _rollup(900), "rollup_3600s": _rollup(3600)} | {f.__name__: f for f in (
    rollup_multi, rollup_full_aggs, rollup_reduction, named_filter, series_catalog, series_arrays, dataset_stats, label_top10, string_table, string_redundancy, columnar_benefits, series_verify, ts_delta, ts_double_delta,
    delta_decode_roundtrip, rle_runs, rle_roundtrip, interval_regularity, gap_spread, point_ids, id_differences, key_repetition, type_benefits, string_roundtrip, xor_roundtrip, series_compare, rollup_store, table_roundtrip, cbor_roundtrip, wide_unpivot, ts_codec_choice, series_profile, pattern_classify, dict_encode, sparse_encode, int_split, varint_size, delta_zero_share, metadata_dict, method_summary, xor_size)}
