"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, line_dedup, packing, quality
from tidemark.llm.bpe import encode_decode_digests
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary_path
from tidemark.llm.substring_dedup import dedup_substrings

LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(120_000))  # about 1 MB
ROWS = [(1, None, None, None), (2, "", "en", "a"), (3, "one two three", None, None), (3, "one two three", None, None), (None, "one two three", "en", "a"), (5, LONG, "en", "b"), (6, " \n\t", "en", "c"), (None, None, None, None), (7, "one two three", "en", "b")]
#: Columns that operators use inside, with other types.
CLASH = ("tie", "h1", "maybe", "_word", "part", "key", "fp", "g", "gone", "score", "label", "kept_text", "n_links", "component", "pos", "window", "at", "ids")


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.withColumns({c: F.lit(True) for c in CLASH})


def _pairs(rows, *names):
    return sorted(tuple(map(str, (r[n] for n in names))) for r in rows)


PER_ROW = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "substring_dedup": lambda d: dedup_substrings(d, window=13),
    "near_duplicates": lambda d: near_duplicates(d, 3, 9, 10),
    "bpe": lambda d: encode_decode_digests(d, vocabulary_path()),
    "quality": lambda d: quality.scored(d, quality.Machine()),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_for_each_row(odd, name):
    out = PER_ROW[name](odd).collect()
    assert _pairs(out, "doc_id") == sorted((str(i),) for i, *_ in ROWS)
    assert PER_ROW[name](odd.limit(0)).isEmpty()


def test_lines(odd):
    out = line_dedup.dedup_lines(odd, min_sites=2).collect()
    assert {(r.doc_id, r.n_removed) for r in out if r.text == "one two three"} == {(3, 0), (None, 1), (7, 1)}
    assert [r.kept_text for r in out if r.doc_id == 5] == [LONG]


def test_substrings(odd):
    out = dedup_substrings(odd, window=3).collect()
    assert {(r.doc_id, r.n_removed) for r in out if r.n_words == 3} == {(3, 0), (None, 0), (7, 3)}
    assert [(r.n_words, r.n_removed, r.kept_text) for r in out if r.doc_id == 5] == [(120_000, 0, LONG)]


def test_near_copies(odd):
    out = near_duplicates(odd, 3, 9, 10).collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in out if r.n_shingles == 1} == {(3, 3, 1), (None, None, 0), (7, 3, 1)}


def test_tokens(odd):
    out = encode_decode_digests(odd, vocabulary_path()).collect()
    assert {r.decoded_sha256 for r in out if r.doc_id == 5} == {hashlib.sha256(LONG.encode()).hexdigest()}
    assert {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}


def test_two_vocabularies_of_one_name(odd, tmp_path):
    """A vocabulary is known by its content: the second one, without merges, gives a token for each byte."""
    other = tmp_path / "byte_bpe_50k.json"
    spec = json.load(open(vocabulary_path(), encoding="utf-8"))
    spec["model"] |= {"merges": [], "vocab": {t: i for t, i in spec["model"]["vocab"].items() if len(t) == 1}}
    other.write_text(json.dumps(spec))
    short = odd.where("doc_id = 7")
    n = [encode_decode_digests(short, p).first().n_tokens for p in (vocabulary_path(), str(other), vocabulary_path())]
    assert n == [3, 13, 3] and sum(r.length for r in pack(short, str(other)).collect()) == 14


@pytest.mark.parametrize("small", [False, True])
def test_packing(odd, monkeypatch, small):
    if small:  # several ranges
        monkeypatch.setattr(packing, "PART_BYTES", 1 << 16)
    rows = pack(odd.where("doc_id is null or doc_id <> 3 or source is null"), vocabulary_path()).collect()
    total = {}
    for r in rows:
        assert len(np.frombuffer(r.ids, "<u4")) == r.length
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert set(total) == {1, 2, 3, None, 5, 6, 7} and total[1] == total[2] == 1 and total[3] % 2 == 0
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    sizes = [sum(n for _, n in v) for v in by.values()]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)
    assert pack(odd.limit(0), vocabulary_path()).isEmpty()


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, None, None, None), (None, 1, "user", "x"), (2, 5, "assistant", "a" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("window", "loss", "formatted")})
    out = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_chats(turns)).collect()}
    assert out == {1: (3, 0), None: (1, 0), 2: (1, 100_000)}
    assert chat.read_back(chat.format_chats(turns.limit(0))).isEmpty()


def test_fit_on_nothing(spark, odd):
    labels = spark.createDataFrame([(None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    machine = quality.fit(odd, labels)
    assert {r.score for r in quality.scored(odd, machine).collect()} == {0.5}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, odd, tmp_path, name, stage):
    spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, odd, str(tmp_path))
    rows = out.collect()
    if name != "packing":
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        assert {str(r.doc_id) for r in rows} <= {str(i) for i, *_ in ROWS} and 5 in {r.doc_id for r in rows}
    empty = stage(spark, odd.limit(0), str(tmp_path))
    assert empty.isEmpty() and empty.columns == out.columns
