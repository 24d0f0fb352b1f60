"""Conversation repair, source mixing and spelling variants against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, repair, spelling
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
CLASH = ("rank", "size", "key", "tie", "one", "begin", "words", "fault", "h1", "audit", "position", "n", "m", "root", "_part")


def _clash(df):
    return df.withColumns({c: F.lit(True) for c in CLASH})


# ---- conversation repair


def _least(rows):
    """(cost, audit) by trying every edit at every place, from the end; rows: (initial, fault)."""

    @lru_cache(None)
    def rest(i, end, inserts):
        found = [(0, "")] if i == len(rows) and end in ("", "a") else []
        may = {"": "u", "s": "u", "a": "u", "u": "a"}[end]
        if inserts < 3:
            found += [(c + 2, "I" + a) for c, a in rest(i, may, inserts + 1)]
        if i < len(rows):
            initial, fault = rows[i]
            found += [(c + 3, "D" + a) for c, a in rest(i + 1, end, 0)]
            if fault not in (1, 2):
                more = int(fault == 3)
                if initial == may or (initial == "s" and end == ""):
                    found += [(c + more, "K" + a) for c, a in rest(i + 1, initial, 0)]
                found += [(c + 2 + more, "R" + a) for c, a in rest(i + 1, may, 0)]
        return [min(found)] if found else []

    return rest(0, "", 0)[0]


@pytest.mark.parametrize("width", [64, 6])
def test_integers_decide(monkeypatch, width):
    monkeypatch.setattr(repair, "WIDTH", width)
    rng = random.Random(width)
    for k in range(700):
        letters = rng.choice(["suax", "ua", "s"])
        rows = tuple((rng.choice(letters), 1 if k % 7 == 0 and rng.random() < 0.9 else rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, rng.choice([4, 12, 50]))))
        open_ = repair.Repair(1)
        for i, (role, fault) in enumerate(rows):
            open_.add(i, role, fault)
        assert open_.close()[-2:] == _least(rows)


def test_long_conversations_stay_small():
    open_, rng = repair.Repair(1), random.Random(2)
    for i in range(20_000):
        open_.add(i, rng.choice(["user", "assistant", "system"]), rng.choice([0, 0, 0, 1, 2, 3]))
    assert open_.width <= 256 and len(open_.close()[-1]) >= 20_000


def _repaired(rows, audit):
    out, rows = [], iter(rows)
    for edit in audit:
        name = "assistant" if out and out[-1][0][0] == "u" else "user"
        if edit == "I":
            out.append((name, ""))
            continue
        role, text = next(rows)
        if edit != "D":
            out.append((role if edit == "K" else name, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)) and not list(rows)
    return out


def _expected_repair(rows):
    """rows: (turn, role, text) of one conversation after damage, in order."""
    seen, faults, judged = set(), Counter(), []
    for _, role, text in rows:
        bare = text.strip(repair.SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 * (bare[-1] not in ".!?")
        seen.add((role, text))
        faults[fault] += 1
        judged.append((role[:1], fault))
    cost, audit = _least(tuple(judged))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
    out = _repaired([r[1:] for r in rows], audit)
    return gaps, faults[1], faults[2], faults[3], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()


def _damaged(conv, turn, role, text):
    conv, role, text = (" " if v is None else v for v in (conv, role, text))
    code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
    if code == 0:
        return []
    row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
    return [row] * (2 if code == 3 else 1)


def _plain_repair(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv] += _damaged(conv, turn, role, text)
    return {c: _expected_repair(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))) for c, v in found.items()}


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _digests(df):
    rows = repair.repair_digests(df).collect()
    out = {r.conv_id: tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_op11(spark):
    given = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    rows = QUERIES["op11_conversation_repair"](spark, DATA).collect()
    want = _plain_repair([(r.conv_id, r.turn, r.role, r.text) for r in given])
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in rows} == want
    assert any(w[5] for w in want.values())


def test_odd_conversations(spark):
    rows = [(c, t, role, text) for c in (1, 2, None, 40) for t, role, text in [(None, None, None), (0, "system", "Be kind."), (3, "user", "x " * 50_000), (5, "user", "Hi."), (9, "tool", "\t\n"), (12, "assistant", None)]]
    rows += [(50 + i, 0, "user", "One.") for i in range(300)]  # some lose their only row
    df = _clash(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = _plain_repair(rows)
    assert _digests(repair.damage(df)) == want
    assert any(w[6] == "" for w in want.values())
    assert repair.repair_digests(repair.damage(df.limit(0))).isEmpty()


def test_repeats_and_repaired_rows(spark):
    rows = [(1, 0, "assistant", "A."), (1, 0, "assistant", "A."), (1, 1, "assistant", "A."), (1, 2, "user", "B")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plans = repair.plan_repairs(df)
    assert [(r.blank, r.duplicate, r.truncated, r.gaps) for r in plans.collect()] == [(0, 2, 1, 0)]
    made = repair.repaired(df, plans).orderBy("position").collect()
    assert "".join(r.role[0] for r in made) in ("ua", "uaua") and _digests(df)[1] == _expected_repair([r[1:] for r in rows])


# ---- mixing


def _plain_mix(rows):
    """(doc_id, size, source_size, target, taken) by filling targets source by source, and queues word by word."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for n, (_, _, source) in zip(size, rows):
        total[source] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(total.values()) * 1.5, set(order), {}
    budget = int(left)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    return size, total, target, budget


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "é", "b", "zz", "𝄞"][: 3 + 2 * seed - 2]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 80]))), rng.choices(sources, [9, *[1] * (len(sources) - 1)])[0]) for i in range(150)]
    rows += [(200, None, "a"), (201, "\x0b \t", "b"), (None, "x y z", None), (202, "x\x0by", "a")]
    df = _clash(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    size, total, target, budget = _plain_mix(rows)
    out = mixing.mixed_words(df).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.source_size) for r in out))) == sorted(str((d, n, total[s])) for n, (d, _, s) in zip(size, rows))
    source = {d: s for d, _, s in rows}
    taken = defaultdict(int)
    for r in out:
        assert abs(r.target - target[source[r.doc_id]]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert sum(taken.values()) == budget
    assert all(abs(n - target[s]) <= len(total) + 1 for s, n in taken.items())
    assert sorted(map(str, mixing.mixed_words(df.repartition(7)).collect())) == sorted(map(str, out))


def test_mix_is_interleaved(spark):
    rows = [(i, "w " * 10, "ab"[i % 5 == 0]) for i in range(500)]
    sent = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("taken > 0").orderBy("position").collect()
    assert [r.position for r in sent] == list(np.cumsum([0] + [r.taken for r in sent[:-1]]))
    got, share = Counter(), {r.rank: r.target for r in sent}
    for r in sent:
        got[r.rank] += r.taken
        for k, n in got.items():  # in any prefix of the mix, a source has its share but for a document
            assert abs(n - share[k] * (r.position + r.taken) / sum(share.values())) <= 10 * len(share)


def test_odd_mixes(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mixed_words(spark.createDataFrame([], kind)).isEmpty()
    none = mixing.mixed_words(spark.createDataFrame([(1, None, None), (1, None, None), (2, " ", "a")], kind)).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in none) == [(1, 0, 0.0, 0), (1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    same = mixing.mixed_words(spark.createDataFrame([(1, "a b", "x")] * 3, kind)).collect()
    assert sorted(r.taken for r in same) == [2, 3, 4] and {r.target for r in same} == {9.0}


def test_many_sources_by_shuffle(spark, monkeypatch):
    rows = [(i, "w " * (i % 9), f"s{i % 60}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mixed_words(df).collect()))
    monkeypatch.setattr(mixing, "FEW", 5)
    assert sorted(map(tuple, mixing.mixed_words(df).collect())) == want


# ---- spelling


def _variants(count, letters="abü"):
    form, near = {}, {}
    for w in count:
        around = {w[:i] + w[i + 1 :] for i in range(len(w))}
        around |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        around = (around - {w}) & count.keys()
        best = min(around, key=lambda x: (-count[x], x), default=None)
        near[w], form[w] = len(around), best if best and count[best] >= 5 * count[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), count[w], near[w], count[form[w]] if form[w] else None) for w in count}


@pytest.mark.parametrize("limit", [spelling.LIMIT, 25])
def test_spelling(spark, monkeypatch, limit):
    monkeypatch.setattr(spelling, "CELLS", 500)
    rng = random.Random(limit)
    count = {"".join(rng.choice("abü") for _ in range(rng.randint(1, 9))): rng.choice([1, 2, 5, 30, 150, 800]) for _ in range(900)}
    count |= {"x" * 5000: 9, "x" * 5001: 90, "𝄞bü": 1}
    df = _clash(spark.createDataFrame(list(count.items()), "word string, n2 long")).drop("n").withColumnRenamed("n2", "n")
    want = _variants({w: n for w, n in count.items() if len(w) < 5000}, "abü𝄞")
    want |= {("x" * 5000, "x" * 5001, "x" * 5001, 9, 1, 90), ("x" * 5001, None, "x" * 5001, 90, 1, None)}
    rows = spelling.spelling_variants(df, limit=limit).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def _plain_words(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def test_words(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("aBÉé") for _ in range(rng.randint(4, 8))) for _ in range(400))) for i in range(60)]
    rows += [(None, rows[0][1]), (7, None), (8, ""), (9, "x" * 300_000 + "-Ünicode"), *[(i, "ßtraße×÷ÿ") for i in range(5)]]
    monkeypatch.setattr(spelling, "KEPT", 1000)
    got = spelling.words(_clash(spark.createDataFrame(rows, "doc_id long, text string")).drop("n")).collect()
    assert {r.word: r.n for r in got} == _plain_words(rows) and "ßtraße×÷ÿ" in {r.word for r in got}


def test_no_words(spark):
    none = spelling.spelling_variants(spelling.words(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string")))
    assert none.isEmpty() and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_op13(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    count = _plain_words(docs)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    rows = QUERIES["op13_spelling_variants"](spark, DATA).collect()
    want = _variants(count, letters)
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows} == want and len(rows) == len(want)
