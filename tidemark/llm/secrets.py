"""Secret scans with an incremental blob ledger, native Spark expressions only.

Every version of a text is addressed by its SHA-256. The ledger is a folder of immutable Parquet runs of
(blob, rules, findings); a scan looks only at pairs of blob and rule version that no run has, and findings are
joined back to all paths and versions that hold the blob. A ledger is opened by the finished runs in its folder, so it
outlives its session; other rules come with another version name and are scanned beside the old ones.

Defined cases: a null text is the empty blob (no findings); copies are scanned once and reported for
each path; repeated rows give repeated results; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, subfolders, table

KINDS = ("assign", "access", "hex")
#: Kind -> (Java pattern, group that is measured, least length). Matches that are too short are dropped after
#: matching. For access and hex a run that is too short has no longer run inside it, so the length can stand in the
#: pattern; for assign it can't, as a dropped match still uses up its characters.
RULES = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
RULES_VERSION = "base-1"
#: Matches that are folded together; arrays and texts grow by parts of so many, so long lists take no squared time.
PART = 64
SPAN = "struct<start:long,ord:int,end:long>"


def _parts(array: Column) -> Column:
    """The array in parts of PART elements."""
    n = F.ceil(F.size(array) / PART).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(array, k * PART + 1, F.lit(PART)))).otherwise(F.slice(F.array(array), 1, 0))


def _carried(parts: Column, fold) -> Column:
    """For each part what fold(value before, part) gives over the parts before it, from 0 on."""
    step = lambda acc, part: F.struct(fold(acc["now"], part).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def _spans(text: str, kind: str, rule: tuple[str, int, int]) -> list[tuple[str, Column]]:
    """Columns, each built on the ones before, that end in <kind>: array of (start, ord, end) of kept matches."""
    pattern, group, least = rule
    m, z, none = f"m_{kind}", f"z_{kind}", F.array().cast(f"array<{SPAN}>")
    lengths = F.transform(F.col(m), F.length)
    gaps = F.transform(F.split(F.col(text), pattern, -1), F.length)
    measured = lengths if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    found = F.slice(F.arrays_zip(gaps.alias("g"), lengths.alias("l"), measured.alias("n")), F.lit(1), F.size(m))
    span = lambda at, x: F.struct((at + x["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (at + x["g"] + x["l"]).alias("end")).cast(SPAN)
    step = lambda acc, x: F.struct(
        (acc["at"] + x["g"] + x["l"]).alias("at"),
        F.when(x["n"] >= least, F.concat(acc["out"], F.array(span(acc["at"], x)))).otherwise(acc["out"]).alias("out"),
    )
    total = lambda now, part: F.aggregate(part, now, lambda acc, x: acc + x["g"] + x["l"])
    inside = lambda part, base: F.aggregate(part, F.struct(base.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return [
        (m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))),
        (z, F.when(F.size(m) > 0, _parts(found))),
        (kind, F.when(F.size(m) > 0, F.flatten(F.zip_with(z, _carried(F.col(z), total), inside))).otherwise(none)),
    ]


def scan(blobs: DataFrame, text: str = "text", rules: dict = RULES, version: str = RULES_VERSION) -> DataFrame:
    """blobs(blob, text) -> (blob, rules, n_assign, n_access, n_hex, spans sorted by start and kind)."""
    found = blobs
    for k in KINDS:
        for name, c in _spans(text, k, rules[k]):
            found = found.withColumn(name, c)
    return found.select(
        "blob",
        F.lit(version).alias("rules"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.concat(*KINDS)).alias("spans"),
    )


def addressed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, text, blob): the blob is the SHA-256 of the UTF-8 text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("path"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("blob"))


class BlobLedger:
    """Ledger of scanned (blob, rule version) pairs in a folder that all executors share."""

    SCHEMA = f"blob binary, rules string, n_assign long, n_access long, n_hex long, spans array<{SPAN}>"

    def __init__(self, spark: SparkSession, path: str, rules: dict = RULES, version: str = RULES_VERSION):
        self.spark, self.path, self.rules, self.version = spark, path.rstrip("/"), rules, version

    def entries(self) -> DataFrame:
        """What the finished runs hold under the present rules."""
        runs = subfolders(self.spark, self.path)
        if not runs:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*(f"{self.path}/{run}" for run in runs)).where(F.col("rules") == self.version)

    def update(self, versions: DataFrame) -> None:
        """Scan the blobs of versions(path, text, blob) that have no entry under the present rules, as a new run."""
        # one path speaks for each blob: only ids and digests are aggregated, copies fold before the shuffle
        unseen = versions.groupBy("blob").agg(F.min("path").alias("path"))
        if subfolders(self.spark, self.path):
            unseen = unseen.join(self.entries().select("blob"), "blob", "left_anti")
        unseen = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"))
        texts = versions.join(unseen, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")), "left_semi")
        # a repeated row gives its blob twice: entries are small, so they are made unique after the scan
        found = scan(texts, rules=self.rules, version=self.version).dropDuplicates(["blob"])
        found.write.option("compression", "zstd").parquet(f"{self.path}/run-{uuid.uuid4().hex}")

    def findings(self, versions: DataFrame) -> DataFrame:
        """Findings for every path and version: (path, n_assign, n_access, n_hex, spans)."""
        return versions.select("path", "blob").join(self.entries().drop("rules"), "blob", "left").drop("blob")


def span_text(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["ord"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every span (and each run of overlapping spans) replaced by the mark. spans: in order of start."""
    parts = _parts(spans)
    reach = lambda now, part: F.aggregate(part, now, lambda acc, s: F.greatest(acc, s["end"]))
    begins = _carried(parts, reach)
    bounds = F.transform(begins, lambda b, k: F.struct(b.alias("lo"), F.coalesce(F.get(begins, k + 1), F.length(text).cast("long")).alias("hi")))
    # a part's stretch of the text is cut out once, and its pieces out of that
    stretches = F.transform(bounds, lambda b: F.substring(text, (b["lo"] + 1).cast("int"), (b["hi"] - b["lo"]).cast("int")))

    def one(x: Column) -> Column:
        lo, hi = x["bound"]["lo"], x["bound"]["hi"]
        piece = lambda a, b: F.substring(x["stretch"], (a - lo + 1).cast("int"), (b - a).cast("int"))
        step = lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece(acc["at"], s["start"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )
        return F.aggregate(x["part"], F.struct(lo.alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], piece(acc["at"], hi)))

    return F.array_join(F.transform(F.arrays_zip(parts.alias("part"), bounds.alias("bound"), stretches.alias("stretch")), one), "")


def redact(spark: SparkSession, docs: DataFrame, ledger_path: str) -> DataFrame:
    """docs with secrets replaced in text; n_chars, where present, follows. Other columns are kept as they are."""
    versions = addressed(docs)
    ledger = BlobLedger(spark, ledger_path)
    ledger.update(versions)
    hits = ledger.entries().where(F.size("spans") > 0).select(F.col("blob").alias("seen"), "spans")
    held = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    out = held.join(hits, F.col("blob") == F.col("seen"), "left")
    out = out.withColumn("text", F.when(F.col("spans").isNotNull(), redacted(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text")))
    n_chars = F.when(F.col("spans").isNotNull(), F.length("text").cast("long"))
    changed = {"text": F.col("text"), "n_chars": F.coalesce(n_chars, F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return out.select(*(changed[c].alias(c) if changed.get(c) is not None else F.col("row")[c].alias(c) for c in docs.columns))


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of a new ledger: the lower half of the ids, then all documents, of which only unseen blobs are scanned."""
    versions = addressed(table(spark, sf_dir, "documents"))
    ledger = BlobLedger(spark, Scratch(spark, "ledger").path("entries"))
    half = versions.agg(F.percentile_approx("path", 0.5)).first()[0]
    if half is not None:
        ledger.update(versions.where(F.col("path") <= half))
    ledger.update(versions)
    found = ledger.findings(versions)
    return found.select(
        F.col("path").alias("doc_id"), "n_assign", "n_access", "n_hex",
        F.sha2(span_text(F.col("spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
    )
