"""WARC records inside ZIP archives: writing, and reading back by ranges without extraction.

An archive holds two stored (uncompressed) members: gzip-per-record WARC data and an index of record offsets.
The reader finds the end record and its ZIP64 form, walks the central directory, resolves where the stored
members' bytes begin, and reads only the byte ranges of the records it wants.

Defined cases: a null html is an empty payload; a null url leaves the target out; of equal payloads the one
with the smallest page_id is the response (rows that repeat that id as well), others are revisits; a null
page_id counts after all others; an empty table gives an empty result; other columns are ignored.
Archives go to the shared folder through pyarrow's file systems (file, s3, gs, hdfs), under a name of the task's
attempt, and are listed by the attempts that ended well, so a task that runs again does no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    revisit = fields["WARC-Type"] == "revisit"
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"record {fields['WARC-Record-ID']}: payload and digest differ")
    return {"page_id": number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To", "")), "payload_bytes": size, "payload_digest": told, "payload": None if revisit else payload}


def _directory_ends(f, tail: bytes, tail_at: int, end: int) -> bool:
    """Whether the end record at `end` of the tail tells of a directory that stands where it says."""
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        return end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07"
    if start + length != tail_at + end:
        return False
    f.seek(start)
    return not count or f.read(4) == b"PK\x01\x02"


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members of a ZIP file, from its directories alone."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = len(tail)
    while True:  # the last mark whose comment ends with the file: a comment may hold the mark's bytes itself
        end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        if end + 22 <= len(tail) and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] == len(tail) and _directory_ends(f, tail, tail_at, end):
            break
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07" and (count == 0xFFFF or 0xFFFFFFFF in (length, start)):
        f.seek(struct.unpack_from("<Q", tail, end - 12)[0])
        zip64 = f.read(56)
        if zip64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", zip64, 32)
    f.seek(start)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
        header, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra, k = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # the ZIP64 field has those of the three that overflow, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                plain, packed, header = (next(wide) if v == 0xFFFFFFFF else v for v in (plain, packed, header))
            k += 4 + n
        if method == 0:
            f.seek(header)
            local = f.read(30)
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def write_archives(pages: DataFrame, root: str, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write pages(page_id, url, payload, refers_to, is_revisit) as archives of about archive_bytes, one a partition at least; (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]):
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        held = next(rows, None)
        if held is not None:
            fs.create_dir(base, recursive=True)
        while held is not None:
            # the name is that of this attempt: only what the task reports when it ends is ever read
            name, index, at = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip", [], 0
            with fs.open_output_stream(name) as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
                with z.open(DATA, "w", force_zip64=True) as data:
                    while held is not None and at < archive_bytes:
                        page_id, url, html, refers_to, is_revisit = held
                        raw = gzip.compress(record(page_id, url, html.encode(), refers_to, is_revisit), 5, mtime=0)
                        data.write(raw)
                        index.append(json.dumps([page_id, at, len(raw)]))
                        at += len(raw)
                        held = next(rows, None)
                z.writestr(INDEX, "\n".join(index))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(index)], pa.int64())], names=["path", "records"])

    # the rows come as the join by page_id has dealt them: payloads are not moved once more
    return pages.select("page_id", "url", "payload", "refers_to", "is_revisit").mapInArrow(run, "path string, records long")


def read_archives(archives: DataFrame, root: str) -> DataFrame:
    """The records of archives(path): RECORD columns."""

    def run(batches: Iterator[pa.RecordBatch]):
        fs, _ = pyarrow.fs.FileSystem.from_uri(root)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with fs.open_input_file(path) as f:
                found = members(f, f.size())
                f.seek(found[INDEX][0])
                entries = [json.loads(x) for x in f.read(found[INDEX][1]).decode().split("\n") if x]
                for k in range(0, len(entries), 500):
                    rows = []
                    for _, at, n in entries[k : k + 500]:
                        f.seek(found[DATA][0] + at)
                        rows.append(parse(zlib.decompress(f.read(n), wbits=31)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds)], names=names)

    # the number of archives is that of the partitions that wrote them; one task reads about one
    return archives.select("path").repartition(max(1, archives.count()), "path").mapInArrow(run, RECORD)


def decide(spark: SparkSession, pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) with payload, is_revisit, refers_to. Only ids and digests meet by payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    ids = pages.select("page_id", F.unhex(F.sha2(payload, 256)).alias("sha")).where(F.octet_length(payload) >= min_bytes)
    firsts = scratch.put(ids.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")
    again = ids.join(firsts.withColumnRenamed("sha", "__sha"), F.col("sha") == F.col("__sha")).where("first IS NOT NULL AND NOT page_id <=> first")
    again = again.select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), F.col("first").alias("refers_to")).distinct()
    held = pages.select("page_id", "url", payload.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256)))
    out = held.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha")), "left")
    return out.select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("is_revisit"))


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    scratch = Scratch(spark, "warc")
    root = scratch.path("archives")
    archives = scratch.put(write_archives(decide(spark, pages, scratch, min_bytes), root), "list")
    return read_archives(archives, root)


def op9_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
