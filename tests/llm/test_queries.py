"""Queries against their SQL, and the pipeline's stages against plain versions."""

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from rolefit.llm.queries import ORACLES, QUERIES

from .conftest import SF
from .test_bpe import LIBRARY
from .test_lines import brute as lost_lines
from .test_row_operators import contained
from .test_simhash import classes, plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(llm, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    found = QUERIES[name](llm, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*columns).collect())


def test_pipeline_stage_by_stage(llm):
    docs = llm.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        given = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.cut(stage(llm, docs, SF), name)
        rows = {r.doc_id: r for r in docs.collect()}
        texts = {i: r.text for i, r in rows.items()}
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "language_id":
            assert set(texts) <= set(given) and all(any(c.isalpha() for c in t) for t in texts.values())
            assert len(texts) >= 0.97 * sum(any(c.isalpha() for c in t or "") for t in given.values())
        elif name == "line_dedup":
            gone = lost_lines(list(given.items()), 0.8)
            left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k, t) not in gone) for i, t in given.items()}
            assert texts == {i: t for i, t in left.items() if t.split() or t == given[i]}
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text != given[r.doc_id])
        elif name == "simhash_near_dedup":
            prints = {i: plain(t) for i, t in given.items()}
            group = classes(set(prints.values()), 4)
            assert set(texts) == {min(i for i in given if group[prints[i]] == g) for g in set(group.values())}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in llm.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(given) - set(texts) == {x[0] for x in contained(list(given.items()), items, 5, 0.8)}
        else:
            for r in rows.values():
                assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.text) and r.round_trip and r.n_tokens == len(r.ids) // 4
