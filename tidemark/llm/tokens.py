"""Token ids by a public tokenizer file: encoding with a memo of words, and binary output as Parquet lists.

Defined cases: a null or empty text encodes to the end id alone; texts of any length are encoded whole;
repeated rows are encoded each; rows with a null doc_id come first; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .hashing import byte_slices

END = 2
#: Words kept by a worker between batches and tasks, in two generations, and the characters of the longest word that
#: is kept: 300 bytes each at most, 200 on average.
MEMO, LONGEST = 800_000, 32
#: A cut before a space or line feed that follows another character falls between two tokens of a byte-level
#: tokenizer, unless that character is white space as well.
_PIECE = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = [*map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
_state: dict = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself where it prints, else from U+0100 on."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in same else chr(next(rest)) for b in range(256)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Ids of words met lately that follow `lead` (a space or nothing), as little-endian unsigned 32-bit integers.

    A word not met for a generation goes.
    """

    def __init__(self, words: "_Words", lead: str, limit: int):
        super().__init__()
        self.words, self.lead, self.limit, self.old = words, lead, limit, {}
        self.model, self.mark = words.tokenizer.model, words.letters[ord(" ")] if lead else ""

    def __missing__(self, word: str) -> bytes:
        if "\n" in word:
            line, _, next_line = word.partition("\n")
            if line and next_line and "\n" not in next_line:
                return self[line] + self.words.line_feed + self.words.bare[next_line]
            return b"".join(map(self.words.piece, _PIECE.findall(self.lead + word)))
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):
                # letters after at most one space are one unit of a byte-level tokenizer: its model takes them directly
                mapped = self.mark + (word if word.isascii() else word.encode().decode("latin1").translate(self.words.letters))
                ids = array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()
            else:
                stem = word.rstrip(punctuation)
                if stem != word and stem and stem[-1].isalnum() and stem[-1] < "\u0250":
                    # closing punctuation after a letter or digit is a unit of its own
                    return self[stem] + self.words.bare[word[len(stem) :]]
                ids = self.words.whole(self.lead + word)
        if len(word) > LONGEST:
            return ids
        self[word] = ids
        if len(self) > self.limit // 2:
            self.old = {}  # the last generation is free before the next is copied
            self.old = dict(self)
            self.clear()
        return ids


class _Words:
    """Whole texts to ids. A byte-level tokenizer without a normalizer is given single words, any other the whole text."""

    def __init__(self, tokenizer):
        self.tokenizer, self.letters = tokenizer, _byte_letters()
        before = repr(tokenizer.pre_tokenizer)
        self.by_word = type(tokenizer.model).__name__ == "BPE" and tokenizer.normalizer is None and before.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in before
        self.spaced, self.bare = _Memo(self, " ", MEMO * 7 // 8), _Memo(self, "", MEMO // 8)
        self.line_feed = self.whole("\n")
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]  # these are found before words are

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Spaces and line feeds, then a word or the text's end: the last space goes with the word, a last line feed stands alone."""
        word = piece.lstrip(" \n")
        gap = piece[: len(piece) - len(word)]
        if not gap or not word:
            return self.bare[word] if word else self.whole(gap)
        last = self.spaced[word] if gap[-1] == " " else self.line_feed + self.bare[word]
        return self.whole(gap[:-1]) + last if len(gap) > 1 else last

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in _OTHER_SPACE) or any(c in text for c in self.added):
            return self.whole(text)
        if "  " in text or "\n " in text or text.endswith(" "):
            return b"".join(map(self.piece, _PIECE.findall(text)))
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))


def _words(path: str) -> _Words:
    if _state.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _state.update(path=path, words=_Words(Tokenizer.from_file(path)))
    return _state["words"]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, as the tokenizer gives them for the whole text."""
    return list(map(_words(path).encode, texts))


def encode_column(texts: pa.Array, path: str) -> list[bytes]:
    """The same for a column of UTF-8 texts; null is the empty text."""
    return encode(texts.cast(pa.string()).fill_null("").to_pylist(), path)


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None, encoding: str = "dictionary", row_group_ids: int = 2 << 20, page_kb: int = 64, page_rows: int = 64, end_id: int = END) -> DataFrame:
    """Write (doc_id, start, n_tokens, ids) in ascending doc_id order, one Parquet file a range of ids.

    Returns (part, path, documents, total), a row a file; start counts the ids before the document in its file.
    A row group ends once it has row_group_ids ids, pages hold page_kb and page_rows at most, and page indexes on doc_id and start find
    single documents without reading ids. encoding: 'dictionary' or 'delta'. Files are written under a name of the
    attempt and renamed when whole, through pyarrow's file systems.
    """
    path, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()
    columns = ["doc_id", "start", "n_tokens", "ids.list.element"]
    layout = {"use_dictionary": columns[3:], "column_encoding": dict.fromkeys(columns[:3], "DELTA_BINARY_PACKED")} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": dict.fromkeys(columns, "DELTA_BINARY_PACKED")}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(out)
        part = TaskContext.get().partitionId()
        name, at, documents, held, held_ids, writer = f"{base}/part-{part:06d}.parquet", 0, 0, [], 0, None
        partial = f"{name}.{uuid.uuid4().hex}"
        for b in byte_slices(batches, 1):
            if writer is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(partial)
                writer = pq.ParquetWriter(sink, schema, compression="zstd", write_page_index=True, data_page_size=page_kb << 10, max_rows_per_page=page_rows, **layout)
            ids = [x + end for x in encode_column(b.column(1), path)]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            stops = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, stops).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            held.append(pa.RecordBatch.from_arrays([b.column(0), pa.array(at + stops - n), pa.array(n), lists], schema=schema))
            at, documents, held_ids = at + int(stops[-1]), documents + len(n), held_ids + int(stops[-1])
            if held_ids >= row_group_ids:
                writer.write_table(pa.Table.from_batches(held))
                held, held_ids = [], 0
        if writer is not None:
            if held:
                writer.write_table(pa.Table.from_batches(held))
            writer.close()
            sink.close()
            if fs.get_file_info(name).type != pyarrow.fs.FileType.NotFound:  # by an attempt of this task that was lost afterwards
                fs.delete_file(name)
            fs.move(partial, name)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([documents], pa.int64()), pa.array([at], pa.int64())], names=["part", "path", "documents", "total"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "part int, path string, documents long, total long")


def _scan(files: DataFrame, out: str, each, schema: str) -> DataFrame:
    """each(row group table, ids before its file) -> record batch, over all files; a task reads about one file."""

    def run(batches):
        fs, _ = pyarrow.fs.FileSystem.from_uri(out)
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(path) as f:
                    reader = pq.ParquetFile(f)
                    for k in range(reader.num_row_groups):
                        yield each(reader.read_row_group(k, use_threads=False).combine_chunks(), base)

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    based = files.select("path", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return based.repartition(max(1, files.count()), "path").mapInArrow(run, schema)


def read_token_files(files: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of files(part, path, total), start counted over all files."""

    def each(t, base):
        return t.set_column(1, "start", pc.add(t["start"], base)).to_batches()[0]

    return _scan(files, out, each, "doc_id long, start long, n_tokens long, ids array<int>")


def select_tokens(spark: SparkSession, files: DataFrame, ids: list[int] | None = None, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "ids")) -> DataFrame:
    """The columns of chosen documents (of all, where ids is None) from files(part, path, total).

    Spark's own reader is told the ids, so files, row groups and then pages are passed over by their statistics and
    page indexes, and columns that are not asked for are not read: metadata costs no token pages.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    based = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    paths = [r.path for r in files.select("path").collect()]  # a row a file
    schema = "doc_id long, start long, n_tokens long, ids array<int>"
    if not paths:
        return spark.createDataFrame([], schema).select(*columns)
    held = spark.read.schema(schema).parquet(*paths)
    if ids is not None:
        held = held.where(F.col("doc_id").isin([int(i) for i in ids]))
    if "start" not in columns:
        return held.select(*columns)
    held = held.select(*columns, F.col("_metadata.file_name").alias("name")).join(based, F.col("name") == F.col("file"))
    return held.select(*((F.col("start") + F.col("base")).alias("start") if c == "start" else c for c in columns))


def digests(files: DataFrame, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files; n_tokens is counted from the ids read."""

    def each(t, base):
        ids = t["ids"].combine_chunks() if isinstance(t["ids"], pa.ChunkedArray) else t["ids"]
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4", copy=False)
        crc = [zlib.crc32(flat[i:j]) for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
        doc, start = (t[c].combine_chunks() for c in ("doc_id", "start"))
        doc, start = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (doc, start))
        return pa.RecordBatch.from_arrays([doc, pc.add(start, base), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _scan(files, out, each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    out = scratch.path("files")
    files = scratch.put(write_token_files(table(spark, sf_dir, "documents"), out), "list")
    return digests(files, out)
