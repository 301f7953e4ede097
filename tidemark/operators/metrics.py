"""Metric series: rollups, catalogs, profiles, sequence transforms and the pattern classifier.

Every function takes points(ts_s, seq, metric_name, labels, value, series): seconds, a number that orders points of one
second, labels as a map, and the series' key (sources.views.with_series). Only dimensions, one row a series or a
string, are ordered globally; sequences of a series run in blocks (operators.sequences).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import BLOCK, expanded, neighbours, numbered, ranked_values, running, runs

#: Seconds of a block of a series in time order.
DAY = 86_400
INTERVALS = (300, 900, 3600)


def bucket(seconds: int, ts: str = "ts_s") -> Column:
    return F.col(ts) - F.pmod(F.col(ts), F.lit(seconds))


# Rollups


def rollup(points: DataFrame, seconds: int = 300) -> DataFrame:
    return points.groupBy("series", bucket(seconds).alias("bucket")).agg(F.round(F.avg("value"), 6).alias("avg_value"), F.count("*").alias("points"))


def _sums(points: DataFrame, seconds: int) -> DataFrame:
    return points.groupBy("series", bucket(seconds).alias("at")).agg(F.sum("value").alias("s"), F.count("*").alias("n"))


def rollup_multi(points: DataFrame, intervals: tuple[int, ...] = INTERVALS) -> DataFrame:
    """All intervals from one pass: the sums of their greatest common divisor are rolled up further."""
    fine, out = _sums(points, math.gcd(*intervals)), None
    for i in intervals:
        part = fine.groupBy("series", bucket(i, "at").alias("bucket")).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("avg_value"), F.sum("n").alias("points"))
        part = part.select("series", F.lit(i).cast("long").alias("interval_seconds"), "bucket", "avg_value", "points")
        out = part if out is None else out.union(part)
    return out


def rollup_reduction(points: DataFrame, intervals: tuple[int, ...] = INTERVALS) -> DataFrame:
    """How many points an interval leaves."""
    fine, out = _sums(points, math.gcd(*intervals)), None
    for i in intervals:
        part = fine.groupBy("series", bucket(i, "at")).agg(F.sum("n").alias("n")).agg(F.count("*").alias("kept"), F.sum("n").alias("points"))
        part = part.select(F.lit(i).cast("long").alias("interval_seconds"), "kept", "points", F.round(F.try_divide("points", "kept"), 6).alias("ratio"))
        out = part if out is None else out.union(part)
    return out


def rollup_full(points: DataFrame, by: tuple[str, ...] = ("metric_name",), seconds: int = DAY) -> DataFrame:
    """Count, sum, mean, extremes, first and last by time; median and deviation from two values on, p95 and p99 from four.

    Order statistics come from counts of distinct values, which no task holds as a whole.
    """
    p, keys = points.withColumn("bucket", bucket(seconds)), (*by, "bucket")
    at = F.struct("ts_s", "seq")
    stats = p.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"), F.round(F.stddev_samp("value"), 6).alias("deviation"),
    )
    n = F.col("n")
    places = {"p95": F.least(F.floor(n * 0.95), n - 1), "p99": F.least(F.floor(n * 0.99), n - 1), "m0": F.floor((n - 1) / 2), "m1": F.floor(n / 2)}
    ranks = ranked_values(p, keys, "value").join(stats.select(*keys, "n"), list(keys))
    picks = ranks.groupBy(*keys).agg(*(F.max(F.when((F.col("upto") - F.col("count") <= place) & (place < F.col("upto")), F.col("value"))).alias(name) for name, place in places.items()))
    out = stats.join(picks, list(keys))
    return out.select(
        *keys, "n", "total", "mean", "low", "high", "first_value", "last_value", F.when(n >= 2, F.round((F.col("m0") + F.col("m1")) / 2, 6)).alias("middle"),
        F.when(n >= 2, F.col("deviation")).alias("deviation"), *(F.when(n >= 4, F.col(q)).alias(q) for q in ("p95", "p99")),
    )


# Catalogs and statistics


def named(points: DataFrame, word: str = "cpu") -> DataFrame:
    """Points whose metric's name holds the word, whatever its case."""
    return points.where(F.contains(F.lower("metric_name"), F.lit(word.lower())))


def series_span(points: DataFrame) -> DataFrame:
    hours = F.round((F.max("ts_s") - F.min("ts_s")) / 3600, 6)
    return points.groupBy("series").agg(F.count("*").alias("points"), F.min("ts_s").alias("first_ts"), F.max("ts_s").alias("last_ts"), hours.alias("hours"))


def series_catalog(points: DataFrame) -> DataFrame:
    """(series_id, series, metric_name, labels, points); ids by first appearance."""
    g = points.groupBy("series").agg(F.first("metric_name").alias("metric_name"), F.first("labels").alias("labels"), F.min("seq").alias("first_"), F.count("*").alias("points"))
    return g.select((F.row_number().over(Window.orderBy("first_")) - 1).cast("long").alias("series_id"), "series", "metric_name", "labels", "points")


def with_series_id(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """points with series_id; the catalog, a row a series, is sent or shuffled as Spark's size check finds."""
    return points.join(catalog.select("series", "series_id"), "series")


def id_differences(catalog: DataFrame, data: DataFrame) -> DataFrame:
    """Series ids that only the catalog or only the data has: (side, series_id)."""
    a, b = catalog.select("series_id"), data.select("series_id").distinct()
    return a.exceptAll(b).select(F.lit("catalog").alias("side"), "series_id").union(b.exceptAll(a.distinct()).select(F.lit("data"), "series_id"))


def series_arrays(points: DataFrame, size: int = 4096) -> DataFrame:
    """(series, chunk, timestamps, numbers, points): arrays by (time, value) of at most `size` consecutive points."""
    p = numbered(points, ("series",), ("ts_s", "value", "seq"), F.floor(F.col("ts_s") / DAY))
    own = F.array_sort(F.collect_list(F.struct("pos", "ts_s", "value")))  # `size` rows at most
    return p.groupBy("series", F.floor(F.col("pos") / size).alias("chunk")).agg(own.alias("a"), F.count("*").alias("points")).select("series", "chunk", F.col("a.ts_s").alias("timestamps"), F.col("a.value").alias("numbers"), "points")


def dataset_stats(points: DataFrame) -> DataFrame:
    p = neighbours(ordered(points), ("series",), ("ts_s",), (1,))
    gap, n = F.col("ts_s") - F.col("ts_s_1"), F.countDistinct("series")
    share = lambda c: F.round(100 * F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 4)
    return p.agg(
        F.count("*").alias("points"), n.alias("series"), F.round((F.max("ts_s") - F.min("ts_s")) / 3600, 4).alias("hours"), F.round(F.count("*") / n, 4).alias("per_series"),
        share(gap <= 3600).alias("within_hour_pct"), share(F.col("value") == F.round("value")).alias("whole_pct"),
    )


def interval_regularity(points: DataFrame, seconds: int = 15) -> DataFrame:
    """Over points in order of time: pairs of neighbours of one metric, and the share that lies `seconds` apart."""
    p = numbered(points.select("ts_s", "seq", "metric_name"), (), ("ts_s", "seq"), F.floor(F.col("ts_s") / DAY))
    p = neighbours(p, (), ("metric_name", "ts_s"), (1,)).where(F.col("metric_name") == F.col("metric_name_1"))
    return p.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("ts_s") - F.col("ts_s_1") == seconds).cast("double")), 6).alias("regular_share"))


def gap_spread(points: DataFrame, seconds: int) -> DataFrame:
    """Per series: the share of gaps of at most `seconds`, and how many different gaps there are."""
    d = deltas(points).where("delta IS NOT NULL")
    return d.groupBy("series").agg(F.round(F.avg((F.col("delta") <= seconds).cast("double")), 6).alias("regular_share"), F.countDistinct("delta").alias("deltas"))


def label_top(points: DataFrame, n: int = 10) -> DataFrame:
    """The n most used (label, text)."""
    e = points.select(F.explode("labels").alias("label", "text")).groupBy("label", "text").agg(F.count("*").alias("uses"))
    return e.orderBy(F.desc("uses"), "label", "text").limit(n)


def key_repetition(points: DataFrame) -> DataFrame:
    """How often each label key is written, and for how many texts."""
    return points.select(F.explode("labels").alias("label", "text")).groupBy("label").agg(F.count("*").alias("uses"), F.countDistinct("text").alias("texts"))


def type_benefits(points: DataFrame) -> DataFrame:
    """Integers, floats and strings that a binary form stores by type."""
    return points.agg(F.count("ts_s").alias("integers"), F.count("value").alias("floats"), F.sum(F.size("labels") * 2 + 1).cast("long").alias("strings"))


def strings(points: DataFrame) -> DataFrame:
    """(kind, s): every name, label key and label value, as often as it is written."""
    name = F.array(F.struct(F.lit("name").alias("kind"), F.col("metric_name").alias("s")))
    part = lambda kind, array: F.transform(array, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("s")))
    return points.select(F.explode(F.concat(name, part("key", F.map_keys("labels")), part("value", F.map_values("labels")))).alias("e")).select("e.kind", "e.s")


def string_table(points: DataFrame) -> DataFrame:
    """(s, id): distinct strings in order."""
    return strings(points).select("s").distinct().select("s", (F.row_number().over(Window.orderBy("s")) - 1).cast("long").alias("id"))


def metadata_dictionaries(points: DataFrame) -> DataFrame:
    """(kind, s, id): a dictionary each for names, label keys and label values."""
    return strings(points).distinct().select("kind", "s", (F.row_number().over(Window.partitionBy("kind").orderBy("s")) - 1).cast("long").alias("id"))


def strings_to_ids(points: DataFrame, table: DataFrame) -> DataFrame:
    """points with name_id and label_ids, a map of ids, in place of metric_name and labels."""
    ids = lambda c, name: table.select(F.col("s").alias(c), F.col("id").alias(name))
    sets = points.select("labels").select(F.map_entries("labels").alias("e")).distinct()  # a row for each set of labels
    sets = sets.select("e", F.explode("e").alias("x")).select("e", F.col("x.key").alias("k_"), F.col("x.value").alias("v_"))
    coded = sets.join(ids("k_", "k"), "k_").join(ids("v_", "v"), "v_").groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("label_ids"))
    none = F.create_map().cast("map<bigint,bigint>")
    held = points.withColumn("e", F.map_entries("labels")).join(ids("metric_name", "name_id"), "metric_name").join(coded, "e", "left")
    return held.select(*(c for c in points.columns if c not in ("metric_name", "labels", "series")), "name_id", F.coalesce("label_ids", none).alias("label_ids"))


def ids_to_strings(coded: DataFrame, table: DataFrame) -> DataFrame:
    """The inverse of strings_to_ids."""
    texts = lambda c, name: table.select(F.col("id").alias(c), F.col("s").alias(name))
    sets = coded.select(F.map_entries("label_ids").alias("e")).distinct()
    sets = sets.select("e", F.explode("e").alias("x")).select("e", F.col("x.key").alias("k_"), F.col("x.value").alias("v_"))
    plain = sets.join(texts("k_", "k"), "k_").join(texts("v_", "v"), "v_").groupBy("e").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("labels"))
    held = coded.withColumn("e", F.map_entries("label_ids")).join(texts("name_id", "metric_name"), "name_id").join(plain, "e", "left")
    return held.select(*(c for c in coded.columns if c not in ("name_id", "label_ids")), "metric_name", F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"))


def string_redundancy(points: DataFrame) -> DataFrame:
    u = strings(points).groupBy("s").agg(F.count("*").alias("n"))
    return u.agg(F.sum(F.length("s") * F.col("n")).cast("long").alias("total_chars"), F.sum(F.length("s")).cast("long").alias("unique_chars"), F.count("*").alias("strings"))


def columnar_benefits(points: DataFrame) -> DataFrame:
    own = points.agg(F.countDistinct("series").alias("series"), F.round(F.count("*") / F.countDistinct("series"), 4).alias("avg_points"), F.countDistinct("metric_name").alias("names"))
    used = points.select(F.explode("labels").alias("k", "v")).agg(F.countDistinct("k").alias("label_keys"), F.countDistinct("v").alias("label_values"))
    return own.join(F.broadcast(used))  # a row each


# Sequences


def ordered(points: DataFrame) -> DataFrame:
    """points with pos, the place in its series."""
    return numbered(points, ("series",), ("ts_s", "seq"), F.floor(F.col("ts_s") / DAY))


def deltas(points: DataFrame) -> DataFrame:
    """points with pos, delta and dd: first and second differences of times."""
    p = neighbours(ordered(points), ("series",), ("ts_s",), (1, 2))
    return p.withColumn("delta", F.col("ts_s") - F.col("ts_s_1")).withColumn("dd", F.col("delta") - (F.col("ts_s_1") - F.col("ts_s_2"))).drop("ts_s_1", "ts_s_2")


def from_second_differences(d: DataFrame) -> DataFrame:
    """(series, pos, back): times again from (series, pos, ts_s at 0, delta at 1, dd from 2 on)."""
    step = F.coalesce("dd", "delta", "ts_s")
    parts = d.select("series", "pos", F.when(F.col("pos") == 0, F.lit(0)).otherwise(step).cast("long").alias("x"), F.when(F.col("pos") == 0, F.col("ts_s")).alias("t0"))
    first = running(parts, ("series",), ("pos",), F.floor(F.col("pos") / BLOCK), F.col("x"), "delta")
    return running(first, ("series",), ("pos",), F.floor(F.col("pos") / BLOCK), F.coalesce("t0", "delta"), "back").select("series", "pos", "back")


def unsorted_points(points: DataFrame) -> DataFrame:
    """Per series, points that come (by seq) before the time of the one before them."""
    p = numbered(points, ("series",), ("seq",), F.floor(F.col("seq") / BLOCK))
    p = neighbours(p, ("series",), ("ts_s",), (1,))
    return p.groupBy("series").agg(F.count("*").alias("points"), F.sum(F.coalesce((F.col("ts_s") < F.col("ts_s_1")).cast("long"), F.lit(0))).alias("unsorted"))


def levels(points: DataFrame, step: float) -> DataFrame:
    return ordered(points).withColumn("level", F.floor(F.col("value") / step))


def level_runs(points: DataFrame, step: float = 100) -> DataFrame:
    return runs(levels(points, step), ("series",), "level")


def runs_back(points: DataFrame, step: float = 100) -> DataFrame:
    """(series, pos, level) decoded from the runs."""
    return expanded(level_runs(points, step), ("series",), "level")


def time_codec(points: DataFrame) -> DataFrame:
    """(series, method, t0, n): how a series' times are stored."""
    d = deltas(points).groupBy("series").agg(F.count("*").alias("n"), F.count("delta").alias("k"), F.countDistinct("delta").alias("u"), F.min("ts_s").alias("t0"))
    method = F.when(F.col("n") == 1, "single").when((F.col("k") >= 4) & (F.col("u") == 1), "regular").when((F.col("k") >= 4) & (F.col("u") == 2), "dual_interval").otherwise("delta_rle")
    return d.select("series", method.alias("method"), "t0", "n")


def series_profile(points: DataFrame) -> DataFrame:
    n = F.count("*")
    return points.groupBy("series").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.max("value") - F.min("value"), 6).alias("span"), F.countDistinct("value").alias("levels"),
        F.round(F.var_pop("value"), 4).alias("variance"), n.alias("points"), F.when(n < 100, "<100").when(n < 1000, "100-999").otherwise(">=1000").alias("size_class"),
    )


# The classifier's periods and limits, in the order of its rules.
PERIODS = (6, 12, 24, 60, 300)
NEAR_RANGE, ZERO, ZERO_SHARE, POWER_SHARE, WHOLE_SHARE = 1e-6, 1e-10, 0.3, 0.7, 0.8
RATIO_VARIANCE, RATIO_LOW, RATIO_HIGH, PERIOD_ERROR, MOST_LEVELS, STEPS, SMOOTH = 0.01, 0.9, 1.1, 0.1, 50, 3, 100


def classify(points: DataFrame) -> DataFrame:
    """(series, n, pattern): the first rule that holds. Not-a-number and infinite values make a series random."""
    v, share = F.col("value"), lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    p = neighbours(ordered(points), ("series",), ("value",), (1, *PERIODS))
    p = p.join(points.groupBy("series").agg(F.min_by("value", F.struct("ts_s", "seq")).alias("v0")), "series")
    log = F.when(v > 0, F.when(v >= 1, F.floor(F.ln(v) / F.ln(F.lit(2.0)))).otherwise(F.ceil(F.ln(v) / F.ln(F.lit(2.0)))))
    ratio, odd = F.when(F.col("value_1") != 0, v / F.col("value_1")), F.isnan(v) | (F.abs(v) == float("inf"))
    a = p.groupBy("series").agg(
        F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.max(odd).alias("odd"), share(F.abs(v) < ZERO).alias("zero"), share((v > 0) & (v == F.pow(F.lit(2.0), log.cast("double")))).alias("power"), share(v == F.floor(v)).alias("whole"),
        F.count(ratio).alias("ratios"), F.var_pop(ratio).alias("spread"), F.avg(ratio).alias("ratio"), F.avg((v - F.col("v0")) * (v - F.col("v0"))).alias("away"), *(F.avg(F.abs(v - F.col(f"value_{k}"))).alias(f"m{k}") for k in PERIODS),
    )
    distinct = points.select("series", "value").distinct()
    distinct = distinct.join(a.select("series", "lo", "hi"), "series").withColumn("piece_", F.coalesce(F.floor((v - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) * 64), F.lit(0))).drop("lo", "hi")
    gaps = neighbours(numbered(distinct, ("series",), ("value",), F.col("piece_")), ("series",), ("value",), (1,))
    q = gaps.groupBy("series").agg(F.count("*").alias("levels"), F.countDistinct(v - F.col("value_1")).alias("gaps"))
    n, range_ = F.col("n"), F.col("hi") - F.col("lo")
    pattern = F.when(n < 3, "sparse").when(F.col("odd"), "random").when(range_ == 0, "constant").when(range_ < NEAR_RANGE, "near_constant").when(F.col("zero") > ZERO_SHARE, "sparse").when(F.col("power") > POWER_SHARE, "power_of_2").when(F.col("whole") > WHOLE_SHARE, "mostly_integers")
    pattern = pattern.when((n >= 5) & (F.col("ratios") >= 3) & (F.col("spread") < RATIO_VARIANCE) & (F.col("ratio") > RATIO_LOW) & (F.col("ratio") < RATIO_HIGH), "exponential")
    for k in PERIODS:
        pattern = pattern.when((n >= 20) & (k < F.floor(n / 3)) & (F.col(f"m{k}") / range_ < PERIOD_ERROR), f"periodic_{k}")
    few = F.col("levels") <= F.least(F.lit(MOST_LEVELS), F.floor(n / 5))
    pattern = pattern.when(few & (F.col("levels") >= 3) & (F.col("gaps") <= STEPS), "quantized_stepped").when(few, "quantized").when(F.col("away") < SMOOTH, "smooth").otherwise("random")
    return a.join(q, "series").select("series", "n", pattern.alias("pattern"))


def pattern_summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("pattern").agg(F.count("*").alias("series"), F.sum("n").alias("points"))


def best_and_worst(sizes: DataFrame, n: int = 5) -> DataFrame:
    """sizes(series, points, bytes) -> the n series of the best and of the worst ratio to 8 bytes a value."""
    r = sizes.withColumn("ratio", F.round(F.try_divide(8.0 * F.col("points"), F.col("bytes")), 6))
    best = r.orderBy(F.desc("ratio"), "series").limit(n).select(F.lit("best").alias("end"), "series", "ratio")
    return best.union(r.orderBy("ratio", "series").limit(n).select(F.lit("worst"), "series", "ratio"))


def value_codes(points: DataFrame, step: float = 10, most: int = 255) -> DataFrame:
    """(series, level, n, code): levels by frequency, then first appearance; `most` stands for all beyond."""
    c = points.groupBy("series", F.floor(F.col("value") / step).alias("level")).agg(F.count("*").alias("n"), F.min("seq").alias("f"))
    code = F.row_number().over(Window.partitionBy("series").orderBy(F.desc("n"), "f")) - 1
    return c.select("series", "level", "n", F.least(code, F.lit(most)).cast("long").alias("code"))


def non_zero(points: DataFrame, least: float = 50) -> DataFrame:
    """(series, pos, v): the values that are not taken as zero, with their places."""
    return ordered(points).where(F.col("value") >= least).select("series", "pos", F.col("value").alias("v")).where("v <> 0")


def whole_and_rest(points: DataFrame) -> DataFrame:
    whole = F.floor("value")
    return points.select("series", "seq", whole.alias("whole"), F.round(F.col("value") - whole, 6).alias("rest"))


def zigzag_bytes(x: Column) -> Column:
    """Bytes of a 64-bit integer as a zig-zag varint: seven bits each, ten at most."""
    u = F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))
    return 1 + sum((F.shiftrightunsigned(u, 7 * k) != 0).cast("long") for k in range(1, 10))


def second_difference_bytes(points: DataFrame) -> DataFrame:
    return deltas(points).where("dd IS NOT NULL").groupBy("series").agg(F.sum(zigzag_bytes(F.col("dd"))).alias("bytes"))


def zero_deltas(points: DataFrame, step: float = 100, most: float = 0.7) -> DataFrame:
    """Per series the share of zero differences of levels, and the layout that follows."""
    d = neighbours(levels(points, step), ("series",), ("level",), (1,)).where("level_1 IS NOT NULL")
    share = F.avg((F.col("level") == F.col("level_1")).cast("double"))
    return d.groupBy("series").agg(F.round(share, 6).alias("zero_share"), F.when(share > most, "mask").otherwise("raw").alias("layout"))
