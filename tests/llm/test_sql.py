"""Registered queries of the subpackage against their DuckDB form on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tidemark.llm import mixing, registry, suffixes, windows

DATA = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[str]:
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(con.execute(registry.ORACLE[name]).df())


def test_one_id_with_texts_of_several_lengths(spark):
    """Such rows share their marks; a mark past the end of the shorter text marks nothing there."""
    base = " ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(1, base), (2, "short text"), (2, "lead " + base), (2, base[:700])], "doc_id long, text string")
    got = windows.dedup(spark, docs).collect()
    assert sorted(r.n_words for r in got) == sorted(len(t.split()) for t in (base, "short text", "lead " + base, base[:700]))
    assert next(r.n_removed for r in got if r.doc_id == 1) == 0
    got = suffixes.dedup(spark, docs).collect()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id == 1} == {1: len(base)}
    assert len(got) == 4


def test_slices_do_not_change_the_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    few, many = ({(r.doc_id, r.copies) for r in mixing.plan(spark, docs, slices=n).collect()} for n in (1, 256))
    assert few == many
