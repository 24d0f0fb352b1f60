"""Vectors, ignore rules and scalars on literals and random cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ignore, rulelist, scalars, vectors
from tidemark.operators import chunking

VECTORS = [{}, {"A": 1}, {"A": 2}, {"B": 1}, {"A": 1, "B": 1}, {"A": 2, "B": 1}, {"A": 1, "B": 2, "C": 3}, {"A": 0}]


def _relation(a, b):
    keys = {*a, *b}
    up, down = all(a.get(k, 0) >= b.get(k, 0) for k in keys), all(a.get(k, 0) <= b.get(k, 0) for k in keys)
    return "equal" if up and down else "a-newer" if up else "b-newer" if down else "concurrent"


def test_vectors(spark):
    pairs = [(a, b) for a in VECTORS for b in VECTORS]
    df = spark.createDataFrame(pairs, "a map<string,bigint>, b map<string,bigint>")
    out = df.select("a", "b", vectors.compare_versions("a", "b").alias("r"), vectors.compare_versions("b", "a").alias("m"), vectors.merge_versions("a", "b").alias("ab"), vectors.merge_versions("b", "a").alias("ba"), vectors.increment_version("a", "A").alias("i"), vectors.vectors_equal("a", "b").alias("same")).collect()
    mirror = {"a-newer": "b-newer", "b-newer": "a-newer"}
    for x in out:
        assert x.r == _relation(x.a, x.b) and x.m == mirror.get(x.r, x.r)
        assert x.ab == x.ba == {k: max(x.a.get(k, 0), x.b.get(k, 0)) for k in {*x.a, *x.b}}
        assert x.i == x.a | {"A": x.a.get("A", 0) + 1} and x.same == (x.a == x.b)


def test_null_vectors(spark):
    df = spark.createDataFrame([(None, {"A": 1}), (None, None)], "a map<string,bigint>, b map<string,bigint>")
    assert [r[0] for r in df.select(vectors.compare_versions("a", "b")).collect()] == ["b-newer", "equal"]


RULES = [
    (["*.log"], "a/b.log", False, True), (["*.log", "!keep.log"], "keep.log", False, False), (["build/"], "x/build/y.o", False, True), (["build/"], "x/build", False, False), (["build/"], "x/build", True, True),
    (["/root.txt"], "root.txt", False, True), (["/root.txt"], "a/root.txt", False, False), (["a/**/b"], "a/b", False, True), (["a/**/b"], "a/x/y/b/c", False, True), (["a/**"], "a/x", False, True), (["**/foo"], "x/y/foo", False, True),
    (["a/b"], "a/b/c", False, True), (["a/b"], "x/a/b", False, False), (["x?y"], "xzy", False, True), (["x?y"], "x/y", False, False), (["a[1].txt"], "a[1].txt", False, True), (["a[1].txt"], "a1.txt", False, False),
    (["**"], "any/thing", False, True), (["!x"], "x", False, False), (["node_*/"], "a/node_m/b", False, True), (["#c", "", "a"], "a", False, True), (["build/"], "x\\build\\y", False, True),
]


@pytest.mark.parametrize("lines,path,is_dir,want", RULES)
def test_ignore_rules(spark, lines, path, is_dir, want):
    rules = ignore.parse_rules(lines)
    df = spark.createDataFrame([(path, is_dir)], "path string, d boolean")
    row = df.select(ignore.ignored(rules, "path", is_dir).alias("a"), ignore.ignored(rules, "path", F.col("d")).alias("b"), ignore.matching_rule(rules, "path", is_dir).alias("r")).first()
    assert (row.a, row.b, row.r is not None) == (want, want, want)
    place = df.select(rulelist.last_rule(rules)("path", F.col("d"))).first()[0]
    assert (place >= 0 and not rules[place].negated) == want


def test_automaton_is_the_chain():
    rng = random.Random(1)
    segment = lambda: rng.choice(["a", "b", "ab", "*", "**", "a*", "*b", "?", "a?", "*.log", "x.log", "[a]", "a**b", "?*", "*a*", "b[1]", "**a", ""])
    hits = 0
    for _ in range(800):
        rules = [ignore.Rule(rng.choice(["", "", "/"]) + "/".join(segment() for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "/"]), rng.random() < 0.3) for _ in range(rng.randint(1, 12))]
        listed = rulelist.RuleList(rules)
        for _ in range(10):
            path, is_dir = "/".join(rng.choice(["a", "b", "ab", "x.log", "[a]", "b[1]", "aab", ".log"]) for _ in range(rng.randint(1, 5))), rng.random() < 0.4
            want = max((i for i, r in enumerate(rules) if (x := ignore.rule_regex(r, is_dir)) and re.match(x, path)), default=-1)
            assert listed.last_match(path, is_dir) == want, (rules, path, is_dir)
            hits += want >= 0
    assert 1000 < hits < 8000


def test_automaton_is_fast_with_many_rules():
    rules = [ignore.Rule(p.format(i=i)) for i in range(5000) for p in ("dir{i}/sub{i}/", "*.ext{i}", "/root{i}/**/x{i}", "name{i}")]
    listed = rulelist.RuleList(rules)
    assert [listed.last_match(p) for p in ("dir7/sub7/x/y.ext9", "a/name11/b", "root3/q/r/x3", "none")] == [37, 47, 14, -1]
    assert len(listed.start.deep.literal) == 5000 and not listed.start.deep.other  # no rule is tried one by one


def _plain(pattern, path, is_dir):
    """The rule's meaning by segments and prefixes, without one regular expression for all."""
    only, anchored = pattern.endswith("/"), pattern.startswith("/")
    p = pattern[:-1] if only else pattern
    p = p[1:] if anchored else p
    if not p:
        return False
    one = re.compile("^" + ignore._body(p) + "$" if p != "**" else "^.*$")
    parts = path.split("/")
    depth = len(parts) if is_dir or not only else len(parts) - 1
    if anchored or "/" in p:
        return any(one.match("/".join(parts[:i])) for i in range(1, depth + 1))
    return any(one.match(s) for s in parts[:depth])


def test_rule_regex_against_segments():
    r = random.Random(4)
    for _ in range(20_000):
        pattern = "".join(r.choice(["a", "b", "*", "**", "?", "/", "."]) for _ in range(r.randint(1, 6)))
        path = "/".join("".join(r.choice("ab.") for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4)))
        for is_dir in (False, True):
            x = ignore.rule_regex(ignore.Rule(pattern), is_dir)
            assert bool(x and re.match(x, path)) == _plain(pattern, path, is_dir), (pattern, path, is_dir)


def test_hard_ignored(spark):
    paths = {".git/config": True, "a/.GIT/x": True, ".github/x": False, "a.sync-conflict-k3x-ABCDEFGH23.txt": True, "x.tidemark-tmp": True, "a\\.svn\\b": True, "x.gitignore": False}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.h for r in df.select("path", ignore.hard_ignored("path").alias("h")).collect()} == paths



def test_windows_and_dates(spark):
    rows = [(540, 1080, 539, False), (540, 1080, 540, True), (540, 1080, 1080, False), (1320, 360, 1400, True), (1320, 360, 100, True), (1320, 360, 400, False), (5, 5, 1, True)]
    df = spark.createDataFrame(rows, "a int, b int, m int, want boolean")
    assert all(r[0] == r[1] for r in df.select(scalars.within_window(F.col("a"), F.col("b"), F.col("m")), "want").collect())
    dates = {"2024-02-29": True, "2023-02-29": False, "2024-13-01": False, "2024-2-1": False, "x": False}
    d = spark.createDataFrame([(k,) for k in [*dates, None]], "t string")
    assert {r.t: r.v for r in d.select("t", scalars.is_real_date("t").alias("v")).collect()} == dates | {None: False}


def test_names(spark):
    paths = {"a/b.PNG": ("png", "image/png", 8 << 20), ".env": ("", None, 2 << 20), "x.tar.gz": ("gz", None, 2 << 20), "dir.d/noext": ("", None, 2 << 20)}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    out = {r.p: (r.e, r.m, r.l) for r in df.select("p", scalars.extension("p").alias("e"), scalars.mime_of("p").alias("m"), scalars.compare_limit("p").alias("l")).collect()}
    assert out == paths


def test_strip_trailer(spark):
    cases = {"a\nCo-authored-by: X\n": "a", "a\n\nco-authored-by: X\n\nb": "a\n\nb", "plain\n\n": "plain\n\n", "Co-Authored-By: only": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "m string")
    assert {r.m: r.s for r in df.select("m", scalars.strip_trailer("m").alias("s")).collect()} == cases


def test_pick_slot_and_digest(spark):
    import hashlib

    df = spark.createDataFrame([("p:1", 7, ["x", "y"]), ("q:2", 1, []), ("r", 5, None)], "k string, n int, b array<string>")
    for r in df.select("k", "n", "b", scalars.pick_slot("k", "n").alias("s"), scalars.content_digest("b").alias("d")).collect():
        assert r.s == (int(hashlib.sha256(r.k.encode()).hexdigest()[:8], 16) % r.n if r.n > 1 else 0)
        assert r.d == (hashlib.sha256("\n".join(r.b).encode()).hexdigest() if r.b else "")


def _seeded(seed, n):
    """Bytes of the 32-bit generator that the known chunk vectors were made with."""
    low = lambda x: x & np.uint64(0xFFFFFFFF)
    a = low(np.uint64(seed) + np.uint64(0x6D2B79F5) * np.arange(1, n + 1, dtype=np.uint64))
    t = low((a ^ a >> np.uint64(15)) * (a | np.uint64(1)))
    t = low(t + low((t ^ t >> np.uint64(7)) * (t | np.uint64(61)))) ^ t
    return low(t ^ t >> np.uint64(14)).astype(np.uint8)


@pytest.mark.parametrize("seed,size,lengths", [
    (1, 0, []), (2, 1, [1]), (3, 65_536, [65_536]), (4, 1_048_576, [861_580, 186_996]), (5, 1_048_577, [1_048_577]),
    (6, 3_158_073, [293_470, 1_190_083, 1_360_805, 313_715]), (8, 4_194_304, [1_799_559, 1_248_327, 704_745, 394_744, 46_929]),
])
def test_known_chunks(seed, size, lengths):
    ends = chunking.cut_points(_seeded(seed, size))
    assert np.diff([0, *ends]).tolist() == lengths


def test_known_hashes():
    import hashlib

    data = _seeded(4, 1_048_576)
    assert hashlib.sha256(_seeded(3, 65_536).tobytes()).hexdigest().startswith("ca68af75dd9b4ea1")
    assert hashlib.sha256(data[:861_580].tobytes()).hexdigest().startswith("bf21d3e5cbc4da7c")
