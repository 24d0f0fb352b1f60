"""Near copies, lines, passages: against brute force, with nulls, ties and odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _text, jaccard_join, line_dedup
from tidemark.llm.components import components
from tidemark.llm.jaccard_join import near_duplicates, without_near_duplicates
from tidemark.llm.substring_dedup import dedup_substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 20}", len(t or "")) for i, t in rows], DOCS)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _set(text, k):
    w = _words((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, texts = say(40), []
    for i in range(n):
        k = r.random()
        if texts and k < 0.45:
            w = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        else:
            w = say(r.randint(1, 90))
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w[at:at] = passage
        texts.append(" ".join(w))
    return texts


def _components(texts, k, num, den):
    sets = [_set(t, k) for t in texts]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 2, 1, 2)])
def test_near_duplicates_against_all_pairs(spark, seed, k, num, den):
    texts = _corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(_docs(spark, enumerate(texts)), k, num, den).collect()}
    want = _components(texts, k, num, den)
    assert got == {i: (len(_set(t, k)), want[i]) for i, t in enumerate(texts)}


def _link_numbers(texts, k, num, den):
    sets = [_set(t, k) for t in texts]
    similar = lambda x, y: bool(x and y) and den * len(x & y) >= num * len(x | y)
    return [sum(similar(x, y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]


@pytest.mark.parametrize("seed,k,num,den,block", [(1, 3, 9, 10, 1 << 20), (2, 5, 4, 5, 100), (4, 1, 1, 2, 150)])
def test_links_are_counted_whole(spark, monkeypatch, seed, k, num, den, block):
    """All links count, also between texts of one group and within a component."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block)
    r = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    near = [" ".join(f"n{r.randrange(9)}" if r.random() < 0.02 else w for w in base) for _ in range(40)]
    texts = [*_corpus(seed, 60), *near]
    want = _link_numbers(texts, k, num, den)
    got = {x.doc_id: x.n_links for x in near_duplicates(_docs(spark, enumerate(texts)), k, num, den).collect()}
    assert max(want) > 5 and got == dict(enumerate(want))


def test_links_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "one two"), (4, "One Two"), (5, "one two"), (8, "one two"), (8, "one two"), (8, "three four"), (9, "one two three")]
    got = sorted((str(x.doc_id), x.n_shingles, x.n_links) for x in near_duplicates(_docs(spark, rows), 3, 9, 10).collect())
    assert got == sorted([("1", 0, 0), ("2", 0, 0), ("None", 1, 0), ("4", 1, 2), ("5", 1, 2), ("8", 1, 2), ("8", 1, 2), ("8", 1, 0), ("9", 1, 0)])


def test_near_duplicates_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One Two"), (5, "one two"), (6, long), (7, long + " more"), (None, "one two"), (8, "one two"), (8, "one two"), (9, "one two three")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(_docs(spark, rows).withColumn("g", F.lit(1)).withColumn("prefix", F.lit(2)), 3, 9, 10).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 29998, 6), (7, 29999, 6), (None, 1, None), (8, 1, 4), (8, 1, 4), (9, 1, 9)]
    assert got == sorted(want, key=str)
    kept = {r.doc_id for r in without_near_duplicates(_docs(spark, rows)).collect()}
    assert kept == {1, 2, 3, 4, 6, None, 9}
    assert near_duplicates(_docs(spark, rows).limit(0)).isEmpty()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (4, 4), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, **{i: 5 for i in range(5, 10)}}


def test_word_hashes_over_blocks(monkeypatch):
    text = "aa  b\tlonger-word-than-a-block c\nB aa " * 5
    column = pa.array([text, None, "", "b aa"])
    want = None
    for block in (1 << 20, 16):
        monkeypatch.setattr(_text, "BLOCK", block)
        _text._tables.clear()
        data, offsets = _text.utf8(column)
        starts, ends, doc = _text.words(data, offsets)
        found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
        assert found == _words(text) + ["b", "aa"] and doc.tolist() == [0] * len(_words(text)) + [3, 3]
        h = _text.hashes(data, starts, ends)
        by = {}
        for w, x in zip(found, h.tolist()):
            assert by.setdefault(w, x) == x
        assert len(set(by.values())) == len(by)
        want = want or by
        assert all(want[w] == by[w] for w in by if len(w) <= 16)
    _text._tables.clear()


def _without_windows(rows, k):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    for i, w in words.items():
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                keep[j : j + k] = [False] * k
        yield i, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep) if y).decode()


@pytest.mark.parametrize("seed,k", [(5, 13), (6, 4)])
def test_substrings_against_brute_force(spark, seed, k):
    rows = [*enumerate(_corpus(seed)), (500, None), (501, ""), (502, " x \x0by")]
    out = dedup_substrings(_docs(spark, rows), window=k, layout=False)
    assert sorted(tuple(r) for r in out.collect()) == sorted(_without_windows(rows, k))
    sums = {r.doc_id: r.kept_sha256 for r in dedup_substrings(_docs(spark, rows), window=k, layout=False, digest=True).collect()}
    assert sums == {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in _without_windows(rows, k)}


def test_substrings_keep_layout_and_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(6))
    rows = [(1, f"a\n{p}\tb"), (2, f"c  d\n{p}\n\ne f"), (3, p), (3, p), (None, p), (4, f"{p} z")]
    out = dedup_substrings(_docs(spark, rows), window=6, keep=("lang",)).collect()
    got = sorted([(r.doc_id, r.n_removed, r.kept_text, r.lang) for r in out], key=str)
    want = [(1, 0, f"a\n{p}\tb", "en"), (2, 6, "c  d\ne f", "en"), (3, 6, "", "en"), (3, 6, "", "en"), (None, 0, p, "en"), (4, 6, "z", "en")]
    assert got == sorted(want, key=str)
    assert dedup_substrings(_docs(spark, rows).limit(0)).isEmpty()


def test_lines(spark):
    rows = [(i, f"own {i}\n  Menu | Home \nrest {i % 3}") for i in range(25)] + [(100, None), (101, ""), (None, "Menu | Home")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.dedup_lines(_docs(spark, rows), min_sites=10).collect()}
    assert got[0] == (3, 0, "own 0\n  Menu | Home \nrest 0")
    assert got[1] == (3, 1, "own 1\nrest 1") and got[7] == (3, 1, "own 7\nrest 1")
    assert got[100] == (0, 0, None) and got[101] == (1, 0, "") and got[None] == (1, 1, "")


def test_lines_near_the_threshold_are_exact(spark):
    rows = [(1000 * s + i, f"line of {k} sites") for k in range(7, 14) for s in range(k) for i in (k,)]
    docs = spark.createDataFrame([(i, t, f"s{i // 1000}") for i, t in rows], "doc_id long, text string, source string")
    found = line_dedup.boilerplate(line_dedup._lines(docs.withColumn("tie", F.lit(0))), 10)
    assert found.count() == 4


def test_numbers_hold_their_bounds():
    x = np.arange(1000, dtype=np.uint64)
    assert len(np.unique(_text.mix(x))) == 1000
