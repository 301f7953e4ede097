"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components.

Equal vectors of a label fold into one class first, which gets a number of its own. Classes meet in buckets of their
label by the signs of random projections, in as many tables as the wanted recall at the threshold needs; the number
of signs is the cheapest for the largest label, so buckets stay small as it grows. A bucket is cut into tiles, every
pair of tiles is one small group, and inside it all cosines are computed in double precision; a pair counts in the
first table where it meets. Only sums of links and a spanning forest leave a group, never all pairs.

Defined cases: null label or vector, null or non-finite components, zero vectors and null ids link with
nothing; vectors of other lengths never link; rows that repeat an id count as vectors of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table
from .hashing import key_groups

MIN_COSINE, RECALL, TILE, SEED = 0.98, 0.9999, 1024, 7
#: Cosines that cost as much as moving one vector to one bucket.
MOVE = 1000


def shape(largest: int, min_cosine: float = MIN_COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(signs a table, tables) of least cost for the largest label."""

    def tables(bits: int) -> int:
        p = (1 - math.acos(min_cosine) / math.pi) ** bits
        return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))

    bits = min(range(1, 31), key=lambda k: tables(k) * (MOVE + largest / (1 << k)))
    return bits, tables(bits)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def signatures(classes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """classes(cid, dim, embedding) -> (cid, sigs)."""

    def run(batches):
        planes: dict = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                part = b.filter(pa.array(dims == dim))
                signs = (_matrix(part.column(2)) @ planes[dim] > 0).reshape(part.num_rows, tables, bits)
                sigs = (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, tables, dtype=np.int32)), pa.array(sigs.ravel()))], names=["cid", "sigs"])

    return classes.select("cid", "dim", "embedding").mapInArrow(run, "cid long, sigs array<int>")


BUCKET = ("label", "dim", "t", "sig", "i", "j")
LINKS = "cid long, root long, links long"


def _tile_links(group: pa.RecordBatch, min_cosine: float) -> pa.RecordBatch | None:
    """For each class of one pair of tiles: its links there and a class it is linked with through others."""
    t, i, j = (group[c][0].as_py() for c in ("t", "i", "j"))
    cids, weights, side = (group[c].to_numpy() for c in ("cid", "n", "own"))
    left = np.arange(len(cids)) if i == j else np.flatnonzero(side == i)
    right = left if i == j else np.flatnonzero(side == j)
    if not len(left) or not len(right) or len(cids) < 2:
        return None
    x = _matrix(group["embedding"])
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    sigs, total, parent = None, np.zeros(len(cids), np.int64), np.arange(len(cids))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        a, b = np.nonzero(x[rows] @ x[right].T >= min_cosine)
        a, b = rows[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        if len(a) and t:
            sigs = _matrix(group["sigs"])[:, :t] if sigs is None else sigs
            fresh = ~(sigs[a] == sigs[b]).any(axis=1)
            a, b = a[fresh], b[fresh]
        np.add.at(total, a, weights[b])
        np.add.at(total, b, weights[a])
        for p, q in zip(a.tolist(), b.tolist()):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
    hit = np.flatnonzero(total)
    if not len(hit):
        return None
    roots = np.array([find(k) for k in hit.tolist()], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(cids[hit]), pa.array(cids[roots]), pa.array(total[hit])], names=["cid", "root", "links"])


def bucket_links(rows: DataFrame, min_cosine: float) -> DataFrame:
    """LINKS of rows(BUCKET, cid, n, own, embedding, sigs), group by group: many small groups pass in one batch."""

    def run(batches):
        for group in key_groups(batches, BUCKET):
            found = _tile_links(group, min_cosine)
            if found is not None:
                yield found

    return rows.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(run, LINKS)


def near_duplicates(spark: SparkSession, vectors: DataFrame, min_cosine: float = MIN_COSINE, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding, label)."""
    scratch = Scratch(spark, "embeddings")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("usable", usable)
    classes = v.where("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # the numbers are those of the written table: no id of a row can stand for a class, as rows may share it
    classes = scratch.put(classes.withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = shape(largest, min_cosine, recall)
    signed = scratch.put(signatures(classes, bits, tables), "sigs")
    keyed = classes.select("cid", "label", "dim").join(signed, "cid").select("cid", "label", "dim", F.posexplode("sigs").alias("t", "sig"))
    # buckets of one class go; larger ones are cut into tiles by a hash of the class
    bucket = list(BUCKET[:4])
    full = scratch.put(keyed.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").withColumn("tiles", F.ceil(F.col("m") / tile).cast("int")).drop("m"), "buckets")
    placed = keyed.join(full, bucket).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select(*bucket, F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "cid", "own")
    rows = placed.join(classes.select("cid", "embedding", "n"), "cid").join(signed, "cid").select(*BUCKET, "cid", "n", "own", "embedding", "sigs")
    links = scratch.put(bucket_links(rows, min_cosine), "links")
    counts = links.groupBy(F.col("cid").alias("cid_")).agg(F.sum("links").alias("links"))
    parts = connected_components(spark, links.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    result = classes.join(counts, F.col("cid") == F.col("cid_"), "left").join(parts, F.col("cid") == F.col("node"), "left")
    result = result.select("label", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "cid").alias("root"))
    result = scratch.put(result, "result")
    tops = scratch.put(result.groupBy(F.col("root").alias("root_")).agg(F.min("least").alias("component")), "tops")
    result = result.join(tops, F.col("root") == F.col("root_")).select(F.col("label").alias("label_"), F.col("embedding").alias("embedding_"), "links", "component")
    result = scratch.put(result, "named")
    # rows that are not usable get a null key, which meets nothing
    held = v.select("vec_id", F.when(F.col("usable"), F.col("label")).alias("label"), F.when(F.col("usable"), F.col("embedding")).alias("embedding"))
    out = held.join(result, (F.col("label") == F.col("label_")) & (F.col("embedding") == F.col("embedding_")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))
