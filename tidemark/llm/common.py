"""What the corpus operators share: word rule, scratch tables, connected components.

Scratch tables live in the folder named by ``spark.checkpoint.dir``, which every executor sees. Where the setting
is absent a temporary folder is used if Spark runs in one process (tests); on a cluster that is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


def _hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder that hold a mark of success, in order; none where the folder is missing."""
    fs, at = _hadoop(spark, path)
    found = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()] if fs.exists(at) else []
    return sorted(x for x in found if fs.exists(_hadoop(spark, f"{path}/{x}/_SUCCESS")[1]))


class Scratch:
    """A folder of written tables; a table that is written cuts the lineage and outlives executors.

    The folder goes when the driver's JVM ends, so a returned DataFrame can read it until then.
    """

    def __init__(self, spark: SparkSession, name: str, base: str | None = None):
        self.spark = spark
        self.root = f"{(base or shared_folder(spark)).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex[:12]}"
        fs, at = _hadoop(spark, self.root)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        fs, at = _hadoop(spark, path)
        fs.delete(at, True)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and let Spark drop the shuffle files of finished steps."""
        for name in names:
            self.delete(self.spark, self.path(name))
        self.spark.sparkContext._jvm.System.gc()


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(id, key, text, doc_id) of docs(doc_id, text): id and key tell rows apart that differ in id or text; null texts are empty.

    The id is doc_id, or 64 bits of the text where that is null; the key is 32 more bits of the text.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("id"), F.hash(text).alias("key"), text.alias("text"), "doc_id")


def per_text(texts: DataFrame, spans: DataFrame, *fields: str, keep: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """(id, key, text, spans, kept columns): each of texts with the list of its spans(id, key, fields); a text bounds its list."""
    lists = spans.groupBy(F.col("id").alias("id_"), F.col("key").alias("key_")).agg(F.collect_set(F.struct(*fields)).alias("spans"))
    joined = texts.join(lists, (F.col("id") == F.col("id_")) & (F.col("key") == F.col("key_")), how)
    none = F.array().cast(lists.schema["spans"].dataType)
    return joined.select("id", "key", "text", F.coalesce("spans", none).alias("spans"), *keep)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids that a broadcast may carry: about 16 bytes each on an executor.
BROADCAST_IDS = 500_000


def rows_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in ids(id), a written table: a few ids are sent to the rows, many meet them in a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    ids = ids.select(F.col(ids.columns[0]).alias("__id"))
    return docs.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__id"), "left_semi")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, max_rounds: int = 50) -> DataFrame:
    """Smallest node reachable from each node, by alternating large-star and small-star rounds.

    edges(a, b): long pairs in any direction, loops and repeats allowed; nulls are ignored.
    Returns (node, component) for every node that has an edge to another node. A round needs two
    aggregations by node and two joins; neighbour lists are never collected, so a hub is no hot task:
    its side of each join is two written tables, which Spark may split.
    """
    e = (
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    e = scratch.put(e, "cc0")
    state = _fingerprint(e)
    for k in range(1, max_rounds + 1):
        # large star: every larger neighbour of a node links to the node's smallest neighbour
        both = e.select(F.col("b").alias("u"), F.col("b").alias("v")).union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = scratch.put(both.groupBy("u").agg(F.min("v").alias("m")), f"cc{k}m")
        large = e.join(low, e.b == low.u).select("a", F.col("m").alias("b"))
        large = scratch.put(large.distinct(), f"cc{k}l")
        # small star: a node and its smaller neighbours link to the smallest of them
        low2 = scratch.put(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), f"cc{k}n")
        small = (
            large.join(low2, large.a == low2.u)
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
        )
        e = scratch.put(small.distinct(), f"cc{k}")
        scratch.drop(f"cc{k - 1}", f"cc{k}m", f"cc{k}l", f"cc{k}n")
        now = _fingerprint(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tops)


def _fingerprint(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
