"""Quality rules with risk-controlled thresholds.

Text statistics of every whole document, fixed base limits, and further rules whose cutoffs are chosen on
labelled documents. These are split in two: the ones labelled bad fit the candidates, the ones labelled good are the
holdout that tests them and that nothing is fitted on. The candidates are joint settings of all rules in one nested
path from none to the strictest cutoffs, ordered by what each cutoff adds on the bad documents.
In each stratum (language) the settings are tested along the path, each on the documents that any of its rules
rejects, and the last one is taken before the exact (Clopper-Pearson) upper bound on the rejected share of good
documents exceeds the risk. Multiple testing is corrected twice: testing in a fixed order and stopping at the first
failure needs no share of the error among settings, and the error is divided (Bonferroni) among the strata that are tested:
the largest ones, as many as can prove anything at their share, a choice that depends on the numbers of good labels
alone. A stratum where no setting passes has no rules beyond the base, so few labels mean few rejections.

Defined cases: a null or empty text has 0 words and fails the base limits; a document that has no label, a
null label or conflicting labels (the lower counts) is judged like any other; labels of unknown documents have
no effect; an unlabelled stratum has no rules beyond the base; repeated rows are judged each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, table
from .hashing import byte_slices

MIN_WORDS, MAX_REPEAT_PCT, REPEAT_WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
RISK, ERROR = 0.02, 0.05
#: Rule -> value (SQL over the statistics), cutoffs from the loosest to the strictest; a larger value is worse.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.29, 0.25, 0.2, 0.15, 0.1)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 25.0, 15.0, 12.0, 10.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-1.2, -1.5, -2.0, -2.5, -3.0)),
}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_WORD = re.compile(WORD)
_BLANK = " \t\n\x0b\x0c\r"


def text_stats(text: str) -> tuple[int, ...]:
    words = _WORD.findall(text)
    n, w = len(words), REPEAT_WINDOW
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > w:
        codes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        key = np.zeros(n - w + 1, np.uint64)
        for j in range(w):
            key = key * np.uint64(0x9E3779B97F4A7C15) + codes[j : n - w + 1 + j]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[inverse] > 1)
        if len(starts):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + w, -1)
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated, lines


def statistics(docs: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """doc_id, kept columns and the statistics of each row's whole text."""
    cols = ["doc_id", *keep]
    schema = docs.select(*cols).schema

    def run(batches):
        for b in byte_slices(batches, len(cols)):
            stats = list(zip(*map(text_stats, b.column(len(cols)).cast(pa.string()).to_pylist())))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(cols))), *(pa.array(x, pa.int64()) for x in stats)], names=[*cols, *STATS])

    for s in STATS:
        schema = schema.add(s, "long")
    return docs.select(*cols, "text").mapInArrow(run, schema)


def tail(k: int, n: int, p: float) -> float:
    """The probability of k or fewer of n at the share p."""
    lp, lq = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
    top = max(terms)
    return math.exp(top) * sum(math.exp(t - top) for t in terms)


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the share p at which k or fewer of n has probability `error`."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid > 0 and tail(k, n, mid) > error else (lo, mid)
    return hi


def within(k: int, n: int, risk: float, error: float) -> bool:
    """Whether upper_bound(k, n, error) <= risk."""
    return k <= risk * n and tail(k, n, risk) <= error


def setting_path(bad: Counter) -> list[tuple[int, ...]]:
    """Nested joint settings (number of cutoffs in force of each rule), from the loosest to the strictest.

    bad counts bad documents by the place of the first cutoff of each rule that rejects them. The rule goes next
    that rejects the most that are left, cutoff by cutoff up to there; where none rejects any, the loosest one.
    """
    grids = [len(grid) for _, grid in RULES.values()]
    level, path = [0] * len(grids), []
    while level != grids:
        left = [(first, c) for first, c in bad.items() if all(f >= have for f, have in zip(first, level))]
        gains = [(sum(c for first, c in left if first[r] < k), k, r) for r, grid in enumerate(grids) for k in range(level[r] + 1, grid + 1)]
        _, k, r = max(gains, key=lambda g: (g[0], -g[1], -g[2]))
        while level[r] < k:
            level[r] += 1
            path.append(tuple(level))
    return path


def cutoffs(judged: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> list[tuple]:
    """(lang, cutoff of each rule or None): one row a language that has good labels enough."""
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("__q")).where("__q IN (0, 1)")
    first = [F.expr(f"{len(grid)} - ({' + '.join(f'CAST({value} > {t}D AS INT)' for t in grid)})").alias(f"__{rule}") for rule, (value, grid) in RULES.items()]
    labelled = judged.where("NOT base_failed").join(marks, "doc_id").select("lang", "__q", *first).groupBy("lang", "__q", *(f"__{r}" for r in RULES)).count()
    labelled = labelled.persist()  # at most a row for each stratum, label and combination of cutoffs
    # only strata that have labels enough come to the driver: their number is bounded by that of the labels
    least = next(n for n in range(1, 1 << 30) if within(0, n, risk, error))
    sizes = labelled.where("__q = 1").groupBy(F.col("lang").alias("__lang")).agg(F.sum("count").alias("__n")).where(F.col("__n") >= least)
    bad, good = Counter(), defaultdict(Counter)
    for *places, c in labelled.where("__q = 0").groupBy(*(f"__{r}" for r in RULES)).agg(F.sum("count")).collect():
        bad[tuple(places)] = c
    for lang, *places, c in labelled.where("__q = 1").join(sizes, F.col("lang").eqNullSafe(F.col("__lang"))).select("lang", *(f"__{r}" for r in RULES), "count").collect():
        good[lang][tuple(places)] = c
    labelled.unpersist()
    ranked = sorted(good, key=lambda lang: (-good[lang].total(), lang is not None, lang or ""))
    tested = ranked[: max((m for m, lang in enumerate(ranked, 1) if within(0, good[lang].total(), risk, error / m)), default=0)]
    share = error / max(1, len(tested))
    path, grids, out = setting_path(bad), [grid for _, grid in RULES.values()], []
    for lang in tested:
        by_place = good[lang]
        best, n = (0,) * len(grids), by_place.total()
        for level in path:
            if not within(sum(c for places, c in by_place.items() if any(p < have for p, have in zip(places, level))), n, risk, share):
                break
            best = level
        out.append((lang, *(grid[have - 1] if have else None for grid, have in zip(grids, best))))
    return out


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Kept columns, statistics, base_failed and kept for each row of docs(doc_id, text, lang)."""
    judged = statistics(docs, keep).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words"))
    judged = Scratch(spark, "quality").put(judged, "stats")
    limits = spark.createDataFrame(cutoffs(judged, labels), "__lang string, " + ", ".join(f"__{r} double" for r in RULES))
    rejected = F.lit(False)
    for rule, (value, _) in RULES.items():
        rejected = rejected | F.coalesce(F.expr(value) > F.col(f"__{rule}"), F.lit(False))
    out = judged.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("__lang", *(f"__{r}" for r in RULES))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, columns as they are. Each row goes by its own id, text and language."""
    text = F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest")
    judged = judge(spark, docs.select("doc_id", "text", "lang", text), labels, ("lang", "digest"))
    gone = judged.where("NOT kept").select(F.col("doc_id").alias("id_"), F.col("lang").alias("lang_"), F.col("digest").alias("digest_")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("digest") == F.col("digest_"))
    return docs.select(F.struct("*").alias("row"), "doc_id", "lang", text).join(gone, same, "left_anti").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines")
