"""The pipeline's stages, each written and read again, against brute-force forms of what they promise."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
from test_operators import ASSIGN, WORD, brute_stats, components, encoded

from tidemark.llm import mixing
from tidemark.llm.common import Scratch

DATA = "/root/testdata/sf0.001"


def clean(text):
    """The text with every secret, and each run of secrets that overlap, replaced."""
    found = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", text)]
    out, at = "", 0
    for a, e in sorted(found):
        if a >= at:
            out += text[at:a] + "[REDACTED]"
        at = max(at, e)
    return out + text[at:]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    scratch, columns, at = Scratch(spark, "test"), docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at.append(docs)
        docs = scratch.put(stage(spark, docs, DATA), f"s{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in at]

    # so few labels prove no cutoff: the base limits alone
    kept = {}
    for i, t in texts[0].items():
        n, _, _, _, repeat = brute_stats(t)
        if n >= 20 and 100 * repeat <= 30 * n:
            kept[i] = t
    assert texts[1] == kept

    sets = {}
    for i, t in kept.items():
        w = [x.encode().lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    whose = components(sets, links)
    assert links and texts[2] == {i: t for i, t in kept.items() if whose[i] == i}

    assert texts[3] == {i: clean(t) for i, t in texts[2].items()}

    # the mix: each row as often as planned, and near each source's target
    planned = {r.doc_id: r for r in mixing.plan(spark, at[3]).collect()}
    taken = collections.Counter(r.doc_id for r in at[4].select("doc_id").collect())
    assert taken == {i: r.copies for i, r in planned.items() if r.copies and r["size"]}
    assert all(texts[4][i] == texts[3][i] for i in taken)

    tokens, pieces = encoded(texts[4].items()), collections.defaultdict(list)
    for r in docs.collect():
        assert zlib.crc32(np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(n for p in pieces.values() for _, n in p) == sum(len(tokens[i]) * n for i, n in taken.items())
    for held in pieces.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    ran = corpus_pipeline.run(spark, DATA).select("doc_id", "piece", "length").collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, docs.select("doc_id", "piece", "length").collect()))
