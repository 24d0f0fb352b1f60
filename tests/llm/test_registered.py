"""Every registered opN_ query on the smallest tables: against its SQL, or a plain version of its contract."""

from __future__ import annotations

import glob
import hashlib
import html
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_text_operators import _components, _link_numbers, _set, _without_windows

from tidemark.llm.queries import ORACLE_SQL_BY_QUERY, QUERIES, vocabulary_path

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def _rows(spark, name):
    return QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL_BY_QUERY))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.sql(ORACLE_SQL_BY_QUERY[name])
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_op1(spark, docs):
    ids = sorted(docs)
    texts = [docs[i] for i in ids]
    first, links = _components(texts, 3, 9, 10), _link_numbers(texts, 3, 9, 10)
    want = {i: (len(_set(t, 3)), ids[f], n) for i, t, f, n in zip(ids, texts, first, links)}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in _rows(spark, "op1_jaccard_join")} == want
    assert any(n for _, _, n in want.values())


def test_op3(spark, docs):
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in _without_windows(docs.items(), 13)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in _rows(spark, "op3_substring_dedup")} == want
    assert any(k for _, k, _ in want.values())


def test_op4(spark, docs):
    rows = _rows(spark, "op4_mpeg_audio")
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        payload = raw.ljust(max(576, -(-len(raw) // 576) * 576), b"\xff")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and f"samples={len(payload)};" in r.feature


def test_op5(spark):
    """The given pages have their article in one element; its text is read off here without a model."""
    given = {r.page_id: r.html or "" for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = _rows(spark, "op5_html_extract")
    assert {r.page_id for r in rows} == set(given)
    for r in rows:
        body = re.search(r"<article[^>]*>(.*?)</article>", given[r.page_id], re.S)[1]
        body = re.sub(r"<(script|style)\b.*?</\1>", "", body, flags=re.S)
        body = re.sub(r"</?(p|h\d|div|ul|li|br|section)\b[^>]*>", " ", body)
        want = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", body))).strip()
        assert (r.text, r.n_chars) == (want, len(want))


def test_op6(spark, docs):
    from tidemark.llm import quality

    rows = _rows(spark, "op6_factorisation_machine")
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    machine = quality.fit(table, spark.read.parquet(f"{DATA}/labels.parquet").where(~quality.held_out()))
    at = [r.doc_id for r in rows[:40]]
    import pyarrow as pa

    x = np.concatenate([m for _, m in quality.features(pa.array([docs[i] for i in at]))])
    x = ((x - machine.mean) * machine.scale).astype(float)
    for row, z in zip(rows, x):  # every pair of features, one by one
        v = machine.v.astype(float)
        on = np.flatnonzero(z)
        pairs = sum(float(v[i] @ v[j]) * z[i] * z[j] for k, i in enumerate(on) for j in on[k + 1 :])
        score = 1 / (1 + np.exp(-(float(machine.w0) + z @ machine.w + pairs)))
        assert abs(score - row.score) < 1e-3


def test_op8(spark, docs):
    from tokenizers import Tokenizer

    tokens = {i: [*e.ids, 1] for i, e in zip(docs, Tokenizer.from_file(vocabulary_path()).encode_batch(list(docs.values()), add_special_tokens=False))}
    rows = _rows(spark, "op8_hilbert_packing")
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(tokens[r.doc_id])
        assert zlib.crc32(np.array(tokens[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        of_doc[r.doc_id].append((r.start, r.length))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(of_doc) == set(docs)
    for pieces, whole in [(p, len(tokens[i])) for i, p in of_doc.items()] + [(p, None) for p in of_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == whole if whole is not None else at == 2048 or at & (at - 1) == 0


def test_op9(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, e in zip(docs, tokenizer.encode_batch(list(docs.values()), add_special_tokens=False)):
        want[i] = len(e.ids), sha(",".join(map(str, e.ids))), sha(tokenizer.decode(e.ids, skip_special_tokens=False))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in _rows(spark, "op9_bpe")} == want


def test_op10(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    control = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", control), ("assistant", control)]
    rows = _rows(spark, "op10_chat_format")
    assert {r.conv_id for r in rows} == set(turns) and len(rows) == len(turns)
    for r in rows:
        said = turns[r.conv_id]
        learnt = "".join(t for role, t in said if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(said), len(learnt))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
