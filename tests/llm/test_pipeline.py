"""Each stage of the pipeline against a brute-force version, on the smallest tables."""

from __future__ import annotations

import os

import numpy as np
import pytest
from test_text_operators import _components, _without_windows

import corpus_pipeline
from tidemark.llm import line_dedup

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def _lines(docs):
    sites, keeper = {}, {}
    trim = lambda s: s.strip(" \t\r")
    for i in sorted(docs):
        for line in map(trim, docs[i].text.split("\n")):
            if line:
                sites.setdefault(line, set()).add(docs[i].source)
                keeper.setdefault(line, i)
    bad = {x for x, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    return {i: "\n".join(x for x in d.text.split("\n") if trim(x) not in bad or keeper[trim(x)] == i) for i, d in docs.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    given = _rows(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = _rows(docs)
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = _rows(docs)
        assert set(docs.columns) == COLUMNS and all(r.n_chars == len(r.text) for r in after.values())
        if name == "quality":
            assert 0 < len(after) < len(given) and all(after[i].text == given[i].text for i in after)
        elif name == "line_dedup":
            assert {i: r.text for i, r in after.items()} == _lines(before)
        elif name == "near_copies":
            ids = sorted(before)
            first = _components([before[i].text for i in ids], 5, 4, 5)
            assert set(after) == {i for n, i in enumerate(ids) if first[n] == n}
        else:
            want = {i: kept for i, _, _, kept in _without_windows([(i, r.text) for i, r in before.items()], 50)}
            assert {i: " ".join(r.text.split()) for i, r in after.items()} == want
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    length = {}
    for p in pieces:
        assert len(np.frombuffer(p.ids, "<u4")) == p.length
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
    assert set(length) == set(after) and all(length[p.doc_id] == p.doc_tokens for p in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
