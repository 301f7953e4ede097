"""Substring dedup over word windows with a log-structured fingerprint index.

Documents come in batches of ascending ids. Every window of `size` words has a fingerprint, the least hash of
the shorter word grams in it, so equal windows have equal fingerprints and neighbours mostly share one. The
index is a folder of immutable runs of (hash, first document), each bucketed and sorted by hash. A batch is hashed
to the same buckets and merge-joined with each run, which moves the batch alone; its new hashes become a run, and
runs are compacted into one when there are more than `fan_in`. An index outlives its session: it is opened by the
runs found in its folder.
Hits are verified on the texts. Neighbouring windows with one fingerprint form a region, and regions are compared
by 128 bits of their words, from two independent codes a word: those an earlier document has as a whole are gone as
a whole. Where a fingerprint has several kinds of region, the windows of the first document of each kind are compared
one by one, by 128 bits too.

Defined cases: null or empty text has no words and no windows; a text shorter than a window keeps all words;
windows of one document count against later documents only, never against itself; rows that share an id count as
one document, each is cut by its own text; a null doc_id is in no batch, its row is kept whole; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, keyed_texts, per_text, subfolders, table
from .hashing import B1, B2, RunHash, U, anchor_runs, anchors, byte_slices, merged, signed, spread, word_codes, word_spans, word_windows

SIZE, GRAM = 13, 5
#: Batches of a call, at least, and rows of a batch, at most. Runs before they are compacted.
BATCHES, BATCH_ROWS, FAN_IN = 4, 50_000_000, 2
#: Words that are joined at once when a text is written out.
JOINED = 100_000


def _lists(parts: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(flat, kind))


def _per_text(codes: np.ndarray, at: np.ndarray, size: int, gram: int):
    """For each text: its first and end word, gram hashes and the anchor gram of each window."""
    grams = word_windows(codes, gram)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        own = grams[i : j - gram + 1] if j - i >= size else grams[:0]
        yield i, j, own, anchors(own, size - gram + 1)


def fingerprints(texts: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(id, batch, hashes) of texts(id, batch, text): the distinct fingerprints of each row's windows."""

    def run(batches):
        for b in byte_slices(batches, 2):
            found = [signed(np.unique(g[a])) for _, _, g, a in _per_text(*word_codes(b.column(2)), size, gram)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(found)], names=["id", "batch", "hashes"])

    return texts.select("id", "batch", "text").mapInArrow(run, "id long, batch int, hashes array<long>")


class FingerprintIndex:
    """Immutable runs of (hash, first), bucketed and sorted by hash: the first document that had a fingerprint."""

    def __init__(self, spark: SparkSession, path: str, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in, self.runs = spark, path.rstrip("/"), fan_in, {}
        for name in subfolders(spark, self.path):  # run-<number>-<buckets>; one without a mark of success was never finished
            if name.startswith("run-"):
                self._open(name)

    def _open(self, name: str) -> str:
        """The run as a table of the session's catalog, which knows its buckets."""
        held = f"tidemark_run_{uuid.uuid4().hex}"
        buckets = int(name.rsplit("-", 1)[1])
        self.spark.sql(f"CREATE TABLE {held} (hash LONG, first LONG) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        self.runs[name] = held
        return held

    def _write(self, rows: DataFrame) -> None:
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        number = max((int(name.split("-")[1]) for name in self.runs), default=0) + 1
        name = f"run-{number:06d}-{buckets}"
        rows.select("hash", "first").repartition(buckets, "hash").write.insertInto(self._open(name))

    def close(self) -> None:
        """Forget the tables; the runs stay in their folder."""
        for held in self.runs.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {held}")
        self.runs = {}

    def add(self, batch: DataFrame, scratch: Scratch) -> DataFrame:
        """batch(id, hash), later than all before -> (id, hash) of documents that share a hash, old ones too."""
        own = batch.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        old = [F.lit(None).cast("long"), F.lit(None).cast("long")]
        for k, held in enumerate(self.runs.values()):
            run = self.spark.table(held).select(F.col("hash").alias(f"hash{k}"), F.col("first").alias(f"old{k}"))
            own = own.join(run.hint("merge"), F.col("hash") == F.col(f"hash{k}"), "left").drop(f"hash{k}")
            old.append(F.col(f"old{k}"))
        own = scratch.put(own.select("hash", "first", "last", F.least(*old).alias("old")), "own")
        shared = scratch.put(own.where("old IS NOT NULL OR first <> last").select(F.col("hash").alias("hash_"), "old"), "shared")
        hits = batch.join(shared, F.col("hash") == F.col("hash_")).select("id", "hash")
        hits = scratch.put(hits.union(shared.where("old IS NOT NULL").select("old", "hash_")), f"hits{uuid.uuid4().hex[:8]}")
        self._write(own.where("old IS NULL"))
        scratch.drop("own", "shared")
        if len(self.runs) > self.fan_in:
            self.compact()
        return hits

    def remember(self, hits: DataFrame, scratch: Scratch) -> DataFrame:
        """hits(id, hash) of this call with those that earlier calls had for the same hashes; kept for later calls.

        The runs name the first document of a hash alone, but any that share it may have the window in question.
        """
        names = [name for name in subfolders(self.spark, self.path) if name.startswith("hits-")]
        kept = self.spark.read.schema("id long, hash long").parquet(*(f"{self.path}/{name}" for name in names)) if names else None
        if kept is not None:
            hashes = scratch.put(hits.select(F.col("hash").alias("hash_")).distinct(), "asked")
            hits = scratch.put(hits.union(kept.join(hashes, F.col("hash") == F.col("hash_"), "left_semi")), "told_before")
        merge = len(names) > self.fan_in
        new = (hits.union(kept) if merge else hits).distinct()
        new.write.option("compression", "zstd").parquet(f"{self.path}/hits-{uuid.uuid4().hex}")
        for name in names if merge else ():
            Scratch.delete(self.spark, f"{self.path}/{name}")
        return hits

    def compact(self) -> None:
        """One run in place of all: written whole before the others go."""
        merged_runs = dict(self.runs)
        rows = None
        for held in merged_runs.values():
            run = self.spark.table(held)
            rows = run if rows is None else rows.union(run)
        self._write(rows.groupBy("hash").agg(F.min("first").alias("first")))
        for name, held in merged_runs.items():
            self.spark.sql(f"DROP TABLE {held}")
            self.runs.pop(name)
            Scratch.delete(self.spark, f"{self.path}/{name}")


def candidate_regions(texts: DataFrame, hits: DataFrame, size: int, gram: int) -> DataFrame:
    """(name, b1, b2, id, key, lo, n): windows lo to lo + n - 1 have the fingerprint name, a hit of their document."""
    wanted = hits.groupBy(F.col("id").alias("id_")).agg(F.collect_set("hash").alias("hashes"))  # within one document
    schema = "name long, b1 long, b2 long, id long, key int, lo int, n int"

    def run(batches):
        for b in byte_slices(batches, 2):
            hashes, out = b.column(3), []
            offsets, values = hashes.offsets.to_numpy(), hashes.values.to_numpy().view(U)
            first, second, at = word_codes(b.column(2), seeds=(0, 1))
            for k, (i, j, g, a) in enumerate(_per_text(first, at, size, gram)):
                lo, n = anchor_runs(a)
                hit = np.isin(g[a[lo]], values[offsets[k] : offsets[k + 1]])
                lo, n = lo[hit], n[hit]
                if len(lo):
                    where = a[lo]
                    shape = (where - lo).astype(U) * B1 + n.astype(U)  # where the anchor is, and how many windows
                    b1, b2 = (RunHash(codes[i:j], base).of(lo, lo + n - 1 + size) + shape for codes, base in ((first, B1), (second, B2)))
                    out.append((np.full(len(lo), k), g[where], b1, b2, lo, n))
            if out:
                k, name, b1, b2, lo, n = (np.concatenate(x) for x in zip(*out))
                k = pa.array(k)
                yield pa.RecordBatch.from_arrays([*(pa.array(signed(x)) for x in (name, b1, b2)), b.column(0).take(k), b.column(1).take(k), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=[x.split()[0] for x in schema.split(", ")])

    joined = texts.join(wanted, F.col("id") == F.col("id_")).select("id", "key", "text", "hashes")
    return joined.mapInArrow(run, schema)


def single_windows(texts: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """(h1, h2, id, key, at): every window of the chosen regions(id, key, lo, n)."""
    schema = "h1 long, h2 long, id long, key int, at int"

    def run(batches):
        for b in byte_slices(batches, 2):
            spans = b.column(3)
            offsets, (los, ns) = spans.offsets.to_numpy(), (spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            first, second, starts = word_codes(b.column(2), seeds=(0, 1))
            out = []
            for k, (i, j) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                at = spread(los[offsets[k] : offsets[k + 1]], ns[offsets[k] : offsets[k + 1]])
                out.append((np.full(len(at), k), word_windows(first[i:j], size, B1)[at], word_windows(second[i:j], size, B2)[at], at))
            k, h1, h2, at = (np.concatenate(x) for x in zip(*out))
            k = pa.array(k)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h1)), pa.array(signed(h2)), b.column(0).take(k), b.column(1).take(k), pa.array(at.astype(np.int32))], names=[x.split()[0] for x in schema.split(", ")])

    return per_text(texts, chosen, "lo", "n").mapInArrow(run, schema)


def verified(texts: DataFrame, hits: DataFrame, scratch: Scratch, size: int, gram: int) -> DataFrame:
    """(id, key, lo, n): runs of windows that an earlier document has."""
    found = scratch.put(candidate_regions(texts, hits, size, gram), "regions")
    kinds = scratch.put(found.groupBy("name", "b1", "b2").agg(F.min("id").alias("first"), F.max("id").alias("last")), "kinds")
    names = scratch.put(kinds.groupBy(F.col("name").alias("name_")).agg(F.count("*").alias("k"), F.max(F.expr("first <> last")).alias("s")).where("k > 1 OR s").select("name_", "k"), "names")
    kinds = kinds.join(names, F.col("name") == F.col("name_")).where("k > 1 OR first <> last")
    kinds = scratch.put(kinds.select("name_", F.col("b1").alias("b1_"), F.col("b2").alias("b2_"), "first", "k"), "open")
    scratch.drop("kinds", "names")
    told = found.join(kinds, (F.col("name") == F.col("name_")) & (F.col("b1") == F.col("b1_")) & (F.col("b2") == F.col("b2_"))).where("id > first OR k > 1")
    told = scratch.put(told.select("id", "key", "lo", "n", F.expr("id > first").alias("gone")), "told")
    scratch.drop("regions", "open")
    singles = scratch.put(single_windows(texts, told.where("NOT gone"), size), "singles")
    firsts = singles.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
    firsts = scratch.put(firsts.select("g1", "g2", "first"), "firsts")
    late = singles.join(firsts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where("id > first")
    marks = scratch.put(told.where("gone").select("id", "key", "lo", "n").union(late.select("id", "key", F.col("at").alias("lo"), F.lit(1).alias("n"))), "marks")
    scratch.drop("told", "singles", "firsts")
    return marks


def cut(texts: DataFrame, marks: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each text without the words under marked windows."""

    def run(batches):
        for b in byte_slices(batches, 2):
            rows, spans = [], b.column(3)
            offsets, (los, ns) = spans.offsets.to_numpy(), (spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2))
            data, begin, end, at = word_spans(b.column(2))
            for k, (i, j) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                own = slice(offsets[k], offsets[k + 1])
                start, stop = merged(los[own], los[own] + ns[own] - 1 + size)
                parts = []
                for p, q in zip([0, *stop.tolist()], [*start.tolist(), j - i]):
                    for s in range(p, q, JOINED):
                        parts.append(b" ".join(data[begin[i + s] : end[i + min(s + JOINED, q) - 1]].tobytes().split()))
                kept = b" ".join(parts)
                rows.append((j - i, int((stop - start).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([b.column(4), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return per_text(texts, marks, "lo", "n", keep=("doc_id",), how="left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup(spark: SparkSession, docs: DataFrame, size: int = SIZE, gram: int = GRAM, batches: int = BATCHES, index_path: str | None = None, history: DataFrame | None = None) -> DataFrame:
    """Each row of docs(doc_id, text) without the words under a window that an earlier document has.

    index_path: the folder of an index that lasts; the documents of earlier calls with it, all of smaller ids, are
    given as history(doc_id, text), of which only those that share a fingerprint are read again to verify.
    """
    scratch = Scratch(spark, "windows")
    texts = keyed_texts(docs)
    with_id = texts.where("doc_id IS NOT NULL").drop("doc_id")
    rows, *_ = docs.agg(F.count("doc_id")).first()
    marks = spark.createDataFrame([], "id long, key int, lo int, n int")
    if rows:
        batches = max(batches, -(-rows // BATCH_ROWS))
        cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)] or [0.5], 10_000)).first()[0] if batches > 1 else []
        number = sum(((F.col("id") > int(c)).cast("int") for c in cuts), F.lit(0))
        prints = fingerprints(with_id.withColumn("batch", number), size, gram)
        prints.write.partitionBy("batch").option("compression", "zstd").parquet(scratch.path("prints"))
        prints = spark.read.schema("id long, hashes array<long>, batch int").parquet(scratch.path("prints"))
        index, hits = FingerprintIndex(spark, index_path or scratch.path("index")), None
        for k in range(batches):
            found = index.add(prints.where(F.col("batch") == k).select("id", F.explode("hashes").alias("hash")), scratch)
            hits = found if hits is None else hits.union(found)
        if index_path:
            hits = index.remember(hits, scratch)
        index.close()
        scratch.drop("prints", *([] if index_path else ["index"]))
        known = with_id if history is None else with_id.union(keyed_texts(history).where("doc_id IS NOT NULL").drop("doc_id"))
        marks = verified(known, hits, scratch, size, gram)
    return cut(texts, marks, size)


def op1_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
