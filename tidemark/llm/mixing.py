"""Mixing sources to target weights by Pareto order sampling, native Spark expressions only.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all words; no target
exceeds twice its source's size, the excess goes to the others by weight. Within a source a document's expected
copies go with a power of its length (by classes of an eighth of a doubling), at most MAX_COPIES, so that the expected
words are the target. Each document first gets the whole copies it expects; for the rest documents are ranked by
random odds over inclusion odds (Pareto order sampling: unequal odds, fixed size) and the ranking is cut where the
words of the target run out. Documents further down that still fit what is left then fill it, in rank order, until
none fits or the source is within TOLERANCE of its target. Documents are taken whole.

Defined cases: null text has size 0 and is taken 0 words; a source without words has target 0; rows equal in id, text
and source are told apart by their number alone, so reruns take equally many of them; an empty table gives an empty result; other columns are ignored.
A source is never one task: ranks run inside slices of the ranking, and only slice totals meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table, word_count

WEIGHTS = (5, 2, 1)
SHARE, MAX_COPIES = 1.5, 2
#: Expected copies go with this power of the length; classes of length for each doubling.
POWER, CLASSES = 0.25, 8
#: At least so many slices, and one for each ROWS rows, so that a window of a hot source stays small at any size.
SLICES, ROWS, TOLERANCE, SEED = 256, 100_000, 0.0005, 20240229
#: Equal rows that are drawn together.
UNIT = 1000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from per-source sizes. The only unpartitioned windows run over one row a source.

    Resharing the excess by weight until none is above ends at min(cap * size, level * weight) for one level:
    with sources ordered by cap * size / weight, it is the first level that the remaining weights can hold.
    """
    by = Window.orderBy(F.col("source").asc_nulls_last())
    up = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by) - 1) % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("total", F.sum("source_size").over(all_) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("k", F.row_number().over(up))
    s = s.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("limit") / F.col("w"), F.col("k"))).over(all_))
    return s.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def length_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * CLASSES).cast("int")


def allocation(classes: DataFrame, goal: DataFrame, power: float = POWER, cap: float = MAX_COPIES) -> DataFrame:
    """(source, class, whole, part, rest, odds) of classes(source, class, words, n) and targets: a few hundred rows a source.

    Expected copies are min(cap, level * length^power), with the level at which the words meet the target: classes
    from the longest down are at the cap until the level that the others need keeps below it. whole + part are the
    expected copies of a document, rest the words that the parts expect, odds those of the source's mean part.
    """
    down = Window.partitionBy("source").orderBy(F.desc("class"))
    before, onward, all_ = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("source")
    c = classes.join(goal.select(F.col("source").alias("source_"), "target"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    c = c.withColumn("w", F.pow(F.lit(2.0), F.col("class") * F.lit(power / CLASSES)))
    level = (F.col("target") - cap * F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("w") * F.col("words")).over(onward)
    c = c.withColumn("level", level)
    c = c.withColumn("level", F.max_by("level", F.when(F.col("level") * F.col("w") <= cap, F.col("class"))).over(all_))
    expected = F.when(F.col("level").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.greatest(F.col("level"), F.lit(0.0)) * F.col("w")))
    c = c.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + F.lit(1e-9)))  # whole numbers up to rounding
    c = c.withColumn("part", F.when(F.col("expected") - F.col("whole") > 1e-9, F.col("expected") - F.col("whole")).otherwise(F.lit(0.0)))
    c = c.withColumn("rest", F.greatest(F.col("target") - F.sum(F.col("whole") * F.col("words")).over(all_), F.lit(0.0)))
    some = F.when(F.col("part") > 0, F.col("n"))
    mean = F.least(F.sum(F.col("part") * some).over(all_) / F.sum(some).over(all_), F.lit(1 - 1e-9))
    return c.select("source", "class", "whole", "part", "rest", (mean / (1 - mean)).alias("odds"))


def _uniform(key: Column, seed: int) -> Column:
    """In (0, 1), the same on every run: 52 bits of a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def _running(docs: DataFrame, what: Column, name: str) -> DataFrame:
    """Adds the sum of `what` over the documents of the source up to and with this one, in rank order."""
    docs = docs.withColumn("x_", what)
    sums = docs.groupBy("source", "slice").agg(F.sum("x_").alias("sum_"))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("source_"), F.col("slice").alias("slice_"), F.coalesce(F.sum("sum_").over(upto), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("source", "slice").orderBy("q", "doc_id", "size", "key", "part_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = docs.withColumn("in_", F.sum("x_").over(inside)).join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("slice") == F.col("slice_")))
    return joined.withColumn(name, F.col("in_") + F.col("before_")).drop("x_", "in_", "before_", "source_", "slice_")


def row_key() -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64("doc_id", "source", "text")


def plan(spark: SparkSession, docs: DataFrame, seed: int = SEED, slices: int = SLICES, power: float = POWER) -> DataFrame:
    """(doc_id, key, size, source, source_size, target, expected, copies) of each row of docs(doc_id, text, source)."""
    scratch = Scratch(spark, "mix")
    # rows alike in id, source and text are one unit of m rows; units of many are cut, and each draws its own number
    unit = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_key().alias("key")).groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("rows"))
    unit = unit.withColumn("part_no", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) DIV {UNIT}"))))
    sized = scratch.put(unit.withColumn("m", F.least(F.lit(UNIT), F.col("rows") - F.col("part_no") * UNIT)), "sized")
    words = F.col("size") * F.col("m")
    slices = max(slices, sized.count() // ROWS)  # the cut doesn't depend on the number of slices
    goal = scratch.put(targets(sized.groupBy("source").agg(F.sum(words).alias("source_size"))), "targets")
    sized = sized.withColumn("class", length_class(F.col("size")))
    classes = sized.where("size > 0").groupBy("source", "class").agg(F.sum(words).alias("words"), F.sum("m").alias("n"))
    shares = scratch.put(allocation(classes, goal, power), "shares")
    # one row a source, some hundred a source: as many as fit a broadcast are sent by Spark's own size check, others are joined
    goal = goal.select(F.col("source").alias("source_"), "source_size", "target")
    d = sized.join(goal, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    shares = shares.select(F.col("source").alias("source_"), F.col("class").alias("class_"), "whole", "part", "rest", "odds")
    d = d.join(shares, F.col("source").eqNullSafe(F.col("source_")) & (F.col("class") == F.col("class_")) & (F.col("size") > 0), "left").drop("source_", "class_", "class")
    u = _uniform(F.xxhash64("key", "part_no"), seed)
    part = F.least("part", F.lit(1 - 1e-12))
    d = d.withColumn("q", F.when(F.col("part") > 0, (u / (1 - u)) / (part / (1 - part))))
    # slices follow the ranking; at the source's mean odds they are about equal
    v = F.col("q") * F.col("odds")
    d = d.withColumn("slice", F.floor(v / (1 + v) * slices).cast("int"))
    room = lambda have: F.greatest(F.lit(0), F.floor((F.col(have) - (F.col("cum") - F.col("size") * F.col("open"))) / F.col("size")))
    ranked = _running(d.where("q IS NOT NULL").withColumn("open", F.col("m")), words, "cum")
    ranked = scratch.put(ranked.withColumn("extra", F.least("m", room("rest")).cast("long")).drop("cum", "open"), "cut")
    passes = 0
    while True:  # each pass takes at least the first unit that fits
        left = ranked.groupBy("source").agg((F.max("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"), F.min(F.when(F.col("extra") < F.col("m"), F.col("size"))).alias("least"), F.max("target").alias("goal"))
        left = scratch.put(left.where((F.col("least") <= F.col("gap")) & (F.col("gap") > TOLERANCE * F.col("goal"))).select(F.col("source").alias("source_"), "gap"), f"gap{passes}")
        if not left.head(1):
            break
        fits = ranked.join(left, F.col("source").eqNullSafe(F.col("source_"))).where((F.col("extra") < F.col("m")) & (F.col("size") <= F.col("gap"))).drop("source_").withColumn("open", F.col("m") - F.col("extra"))
        more = _running(fits, F.col("size") * F.col("open"), "cum").withColumn("more", F.least("open", room("gap")).cast("long")).where("more > 0")
        more = more.select(F.col("doc_id").alias("id_"), F.col("key").alias("key_"), F.col("part_no").alias("part_"), "more")
        ranked = ranked.join(more, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("part_no") == F.col("part_")), "left")
        passes += 1
        ranked = scratch.put(ranked.withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0))).drop("id_", "key_", "part_", "more"), f"pass{passes}")
    done = ranked.select(*d.columns, "extra").unionByName(d.where("q IS NULL").withColumn("extra", F.lit(0).cast("long")))
    # the first `extra` rows of a unit get one copy more
    done = done.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("place"))
    copies = F.coalesce("whole", F.lit(0)) + (F.col("place") <= F.col("extra")).cast("int")
    expected = F.coalesce("whole", F.lit(0)) + F.coalesce("part", F.lit(0.0))
    return scratch.put(done.select("doc_id", "key", "size", "source", "source_size", "target", expected.alias("expected"), copies.cast("int").alias("copies")), "plan")


def mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of docs repeated as often as the mix takes them (0, 1 or 2 times); rows without words go.

    Rows equal in id, text and source share their copies evenly, rounded to whole ones.
    """
    copies = plan(spark, docs).where("size > 0").groupBy(F.col("doc_id").alias("id_"), F.col("key").alias("key_")).agg(F.round(F.avg("copies")).cast("int").alias("copies")).where("copies > 0")
    held = docs.select(F.struct("*").alias("row"), "doc_id", row_key().alias("key"))
    out = held.join(copies, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = plan(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
