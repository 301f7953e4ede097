"""Log templates: typed variables cut out of lines, and lines rebuilt from templates and variables.

Each rule scans the line on its own; matches are taken from the left where they do not overlap (at one start the
earlier rule wins). The scan is an Arrow-batched UDF; everything after it is plain DataFrame work. Variables stay
on their line as an array, so no order is lost when lines are reordered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logs import first_use_ids

# The rules that define the templates, in order of precedence.
RULES = (
    ("IP", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    ("UUID", r"\b\w{8}-\w{4}-\w{4}-\w{4}-\w{12}\b"),
    ("TIMESTAMP", r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"),
    ("TIMESTAMP", r"\b\d{6}\s+\d{6}\b"),
    ("TIMESTAMP", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\b"),
    ("BRACKET_TIME", r"\[\w+\s+\w+\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\d{4}\]"),
    ("PATH", r"/[^\s\]]+"),
    ("IDENTIFIER", r"\b\w*_-?\d+\b"),
    ("HEX", r"\b[0-9a-f]*[a-f][0-9a-f]{7,}\b"),
    ("NUM", r"\b-?\d+\b"),
)
TYPES = ("IP", "UUID", "TIMESTAMP", "BRACKET_TIME", "PATH", "IDENTIFIER", "HEX", "NUM")
#: A text without which a rule has no match, which spares most scans.
_NEEDS = (".", "-", "T", "", ":", "[", "/", "_", "", "")
_RULES = [(kind, need, re.compile(rule)) for (kind, rule), need in zip(RULES, _NEEDS)]
_SCHEMA = "template string, pieces array<string>, kinds array<string>, vars array<string>"


def scan(line: str) -> tuple[str, list[str], list[str], list[str]]:
    """Template, the constant pieces around the variables, and the variables' types and texts."""
    line = line.strip()
    found = sorted((m.start(), k, m.end()) for k, (_, need, rule) in enumerate(_RULES) if need in line for m in rule.finditer(line))
    pieces, kinds, values, at, free = [], [], [], 0, -1
    for start, k, end in found:
        if start >= free:
            pieces.append(line[at:start])
            kinds.append(_RULES[k][0])
            values.append(line[start:end])
            at = free = end
    pieces.append(line[at:])
    template = pieces[0] + "".join(f"<{k}>{p}" for k, p in zip(kinds, pieces[1:]))
    return template, pieces, kinds, values


def extract(lines: DataFrame) -> DataFrame:
    """lines(line_no, line) -> (line_no, line, template, pieces, kinds, vars); null and blank lines are left out."""
    strings = pa.list_(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1).to_pylist()
            keep = [k for k, x in enumerate(text) if x and x.strip()]
            cut = list(zip(*(scan(text[k]) for k in keep))) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(keep, pa.int64())).columns, *(pa.array(c, t) for c, t in zip(cut, (pa.string(), strings, strings, strings)))], names=["line_no", "line", "template", "pieces", "kinds", "vars"])

    return lines.select("line_no", "line").mapInArrow(run, "line_no long, line string, " + _SCHEMA)


def dictionary(extracted: DataFrame) -> DataFrame:
    """(template_id, template, n_lines); ids by first appearance. There may be nearly as many templates as lines."""
    return first_use_ids(extracted, "template").select(F.col("id").alias("template_id"), "template", F.col("uses").alias("n_lines"))


def with_template_id(extracted: DataFrame, templates: DataFrame) -> DataFrame:
    return extracted.join(templates.select("template_id", "template"), "template")


def top(templates: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent templates with their percentage; the one that came first wins ties."""
    total = templates.agg(F.sum("n_lines").alias("total"))
    best = templates.orderBy(F.desc("n_lines"), "template_id").limit(n)
    return best.join(F.broadcast(total)).select("template", "n_lines", F.round(100.0 * F.col("n_lines") / F.col("total"), 4).alias("pct"))


def variables(extracted: DataFrame) -> DataFrame:
    """(line_no, pos, kind, text)."""
    e = extracted.select("line_no", F.posexplode(F.arrays_zip("kinds", "vars")).alias("pos", "v"))
    return e.select("line_no", F.col("pos").cast("long").alias("pos"), F.col("v.kinds").alias("kind"), F.col("v.vars").alias("text"))


def counts(extracted: DataFrame) -> DataFrame:
    """(line_no, n_<type> for each type)."""
    of = lambda t: F.size(F.filter("kinds", lambda k: k == F.lit(t))).cast("long").alias(f"n_{t.lower()}")
    return extracted.select("line_no", *map(of, TYPES))


def rebuild(extracted: DataFrame) -> DataFrame:
    """The lines again, from pieces and variables: a literal placeholder in a line does no harm."""
    inner = F.zip_with(F.slice("pieces", F.lit(1), F.size("vars")), "vars", lambda p, v: F.concat(p, v))
    return extracted.select("line_no", "line", F.concat(F.array_join(inner, ""), F.element_at("pieces", -1)).alias("rebuilt"))


def verify(rebuilt: DataFrame) -> DataFrame:
    """(n_lines, wrong): white space around a line is not part of it."""
    trimmed = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    return rebuilt.agg(F.count("*").alias("n_lines"), F.sum((trimmed != F.col("rebuilt")).cast("long")).alias("wrong"))


def breakdown(extracted: DataFrame, templates: DataFrame) -> DataFrame:
    """(part, bytes, n, n_distinct): template texts, the line's template ids at four bytes, and each variable column."""
    texts = templates.agg(F.lit("templates").alias("part"), F.sum(F.octet_length("template")).cast("long").alias("bytes"), F.count("*").alias("n"), F.count("*").alias("n_distinct"))
    ids = templates.agg(F.lit("template_ids").alias("part"), F.sum(F.col("n_lines") * 4).cast("long").alias("bytes"), F.sum("n_lines").cast("long").alias("n"), F.count("*").alias("n_distinct"))
    v = variables(extracted).groupBy(F.col("kind").alias("part")).agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct"))
    return texts.union(ids).union(v)
