"""Numbers, sums and neighbours along ordered groups of any size: no group is ever one window.

A group is cut into blocks that follow its order; windows run inside a block, and only block totals meet. `block` is
an expression that never falls along the order; equal values of it stand together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block in which neighbours are looked up.
BLOCK = 1 << 16


def running(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], block: Column, what: Column, name: str) -> DataFrame:
    """df with the sum of `what` over the rows of the group up to and with this one."""
    d = df.withColumn("block_", block).withColumn("what_", what)
    totals = d.groupBy(*keys, "block_").agg(F.sum("what_").alias("total_"))
    up = Window.partitionBy(*keys).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*(F.col(k).alias(f"{k}__") for k in keys), F.col("block_").alias("block__"), F.coalesce(F.sum("total_").over(up), F.lit(0)).alias("base_"))
    inside = Window.partitionBy(*keys, "block_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("block_").eqNullSafe(F.col("block__"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    return d.withColumn("own_", F.sum("what_").over(inside)).join(base, same).select(*df.columns, (F.col("own_") + F.col("base_")).alias(name))


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], block: Column, name: str = "pos") -> DataFrame:
    """df with the place of each row in its group, from 0."""
    return running(df, keys, order, block, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def neighbours(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...], steps: tuple[int, ...], at: str = "pos", size: int = BLOCK) -> DataFrame:
    """df with <column>_<step>: the value `step` places before (after, where negative); at: places without gaps.

    Rows near a block's edge are given to the next block too, where they are seen but not kept.
    """
    before, after = max(0, *steps), max(0, *(-k for k in steps))
    assert max(before, after) <= size
    own, inside = F.floor(F.col(at) / size), F.pmod(F.col(at), F.lit(size))
    blocks = F.array_compact(F.array(own, F.when(inside >= size - before, own + 1) if before else F.lit(None), F.when((inside < after) & (own > 0), own - 1) if after else F.lit(None)))
    w = Window.partitionBy(*keys, "block_").orderBy(at)
    seen = df.withColumn("block_", F.explode(blocks))
    for c in columns:
        for k in steps:
            seen = seen.withColumn(f"{c}_{k}" if k > 0 else f"{c}_next{-k}", F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w))
    return seen.where(F.col("block_") == own).drop("block_")


def runs(df: DataFrame, keys: tuple[str, ...], column: str, at: str = "pos") -> DataFrame:
    """(keys, start_pos, column, run_length) of runs of equal values (nulls are equal); start_pos counts from 0."""
    flagged = neighbours(df.select(*keys, at, column), keys, (column,), (1,), at)
    starts = flagged.where((F.col(at) == 0) | ~F.col(column).eqNullSafe(F.col(f"{column}_1"))).select(*keys, F.col(at).alias("start_pos"), column)
    sizes = df.groupBy(*(F.col(k).alias(f"{k}__") for k in keys)).agg(F.count("*").alias("size_"))
    ranked = neighbours(numbered(starts, keys, ("start_pos",), F.floor(F.col("start_pos") / BLOCK), "run"), keys, ("start_pos",), (-1,), "run")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    ranked = ranked.join(sizes, same) if keys else ranked.crossJoin(sizes)  # one row a group
    return ranked.select(*keys, "start_pos", column, (F.coalesce("start_pos_next1", "size_") - F.col("start_pos")).alias("run_length"))


def expanded(found: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Runs back to (keys, pos, column)."""
    return found.select(*keys, F.explode(F.sequence(F.col("start_pos"), F.col("start_pos") + F.col("run_length") - 1)).alias("pos"), column)


def ranked_values(df: DataFrame, keys: tuple[str, ...], value: str, pieces: int = 64) -> DataFrame:
    """(keys, value, count, upto): distinct values of each group and how many rows lie up to and with each."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("count"))
    ends = counts.groupBy(*(F.col(k).alias(f"{k}___") for k in keys)).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}___"))
    piece = F.coalesce(F.floor((F.col(value) - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0)) * pieces), F.lit(0))
    spread = counts.join(ends, same).select(*keys, value, "count", piece.alias("piece_"))
    return running(spread, keys, (value,), F.col("piece_"), F.col("count"), "upto").drop("piece_")
