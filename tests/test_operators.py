"""Operators on small tables: quirks, negative controls and properties."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.ignore import builtin_lines, parse_rules, rule_regex
from tidemark.operators import chunking, commits, common, diff, drift, plan, rollback, rules, scan
from tidemark.sources import files, manifest
from tidemark.streaming import jobs

M = "folder_id string, path string, version map<string,bigint>, size bigint, deleted boolean, blocks array<string>, mtime bigint"


def _m(spark, *rows):
    return spark.createDataFrame([("f", p, v, s, d, b, t) for p, v, s, d, b, t in rows], M)


@pytest.fixture(scope="module")
def sides(spark):
    local = _m(spark, ("a", {"A": 1}, 1, False, ["x"], 1), ("b", {"A": 2}, 2, False, ["y"], 1), ("c", {"A": 1, "B": 1}, 3, False, ["z"], 5), ("d", {"A": 1}, 0, True, [], None), ("e", {"A": 1}, 4, False, ["w"], 1))
    remote = _m(spark, ("a", {"A": 1}, 1, False, ["x"], 9), ("b", {"A": 1}, 2, False, ["y"], 1), ("c", {"A": 2}, 3, False, ["q"], 9), ("g", {"B": 1}, 7, False, ["n"], 1), ("e", {"A": 1}, 4, False, ["v"], 1))
    return local, remote


def test_plan(sides):
    got = {r.path: r.action for r in plan.plan_full(*sides).collect()}
    assert got == {"b": "send", "c": "conflict", "d": "delete", "g": "receive"}
    assert {r.path for r in plan.plan_delta(*sides).collect()} == {"b", "c", "g"}
    assert plan.plan_full(sides[0], sides[0]).isEmpty()


def test_diff_quirks(spark, sides):
    l, r = (diff.to_snapshot(m) for m in sides)
    got = {x.path: x.kind for x in diff.folder_diff(l, r).collect()}
    assert got == {"a": "in-sync", "b": "local-newer", "c": "conflict", "d": "in-sync", "e": "content-mismatch", "g": "remote-newer"}
    counts = diff.diff_counts(diff.folder_diff(l, r)).first()
    assert counts.total == 4 and counts.in_sync == 2


def test_after_applying_nothing_is_received(sides):
    local, remote = sides
    p = plan.plan_full(local, remote)
    o = plan.resolve_conflicts(p, "A")
    after = plan.apply_plan(local, p, o)
    again = {r.path: r.action for r in plan.plan_full(after, remote).collect()}
    assert "receive" not in again.values() and "conflict" not in again.values()


@pytest.mark.parametrize("policy,want", [("keep-both", "keep-both"), ("local-wins", "keep-local"), ("newest-wins", "take-remote")])
def test_conflict_policies(spark, sides, policy, want):
    p = plan.plan_full(*sides)
    policies = spark.createDataFrame([("f", policy)], "folder_id string, policy string")
    assert [r.outcome for r in plan.resolve_conflicts(p, "A", policies).collect()] == [want]


def test_fingerprint(spark, sides):
    local, _ = sides
    same = diff.manifest_fingerprint(local.orderBy(F.desc("path")).withColumn("mtime", F.lit(0).cast("bigint"))).first()
    assert diff.manifest_fingerprint(local).first() == same
    other = diff.manifest_fingerprint(local.withColumn("size", F.col("size") + 1)).first()
    assert other.fingerprint != same.fingerprint
    assert diff.changed_folders(local, local).isEmpty() and diff.changed_folders(local, sides[1]).count() == 1


def test_drift_control(sides):
    found = drift.declared_drift(drift.equal_pairs(*sides)).collect()
    assert [(r.path, r.slot) for r in found] == [("e", 0)]


def test_tree(sides):
    l, r = (diff.to_snapshot(m.withColumn("path", F.concat(F.lit("x/"), "path"))) for m in sides)
    got = {x.path: x.status for x in diff.compare_tree(l, r).collect()}
    assert got["x"] == "diff" and got["x/a"] == "same" and "x/d" not in got and got["x/g"] == "only-remote"


def test_rollback_quirks(spark):
    k = "folder_id string, path string"
    versions = spark.createDataFrame([("f", "old", "old.v1", 50), ("f", "upd", "upd.v1", 150), ("f", "upd", "upd.v2", 160)], f"{k}, file string, ts bigint")
    trash = spark.createDataFrame([("f", "gone", "gone.t", 170)], f"{k}, file string, ts bigint")
    events = spark.createDataFrame([("f", "new", 150, "add"), ("f", "gone", 170, "delete"), ("f", "lost", 170, "delete"), ("f", "edit", 20, "add"), ("f", "edit", 150, "update")], f"{k}, ts bigint, action string")
    current = spark.createDataFrame([("f", "new", 150), ("f", "upd", 10), ("f", "edit", 150), ("f", "calm", 5)], f"{k}, mtime bigint")
    got = {r.path: (r.outcome, r.file) for r in rollback.rollback_plan(versions, trash, events, current, 100).collect()}
    assert got == {"old": ("restore", "old.v1"), "upd": ("restore", "upd.v1"), "new": ("trash-current", None), "gone": ("from-trash", "gone.t"), "lost": ("lost-delete", None), "edit": ("no-snapshot", None)}


def _plain_chunks(raw, least, most, mask):
    g, out, start, fp = chunking.gear().tolist(), [], 0, 0
    for i, b in enumerate(raw):
        fp = ((fp << 1 | fp >> 31) & 0xFFFFFFFF) ^ g[b] ^ (g[raw[i - 32]] if i >= 32 else 0)
        n = i + 1 - start
        if (n >= least and fp & mask == 0) or n >= most or i + 1 == len(raw):
            out.append(i + 1)
            start = i + 1
    return out


@pytest.mark.parametrize("size", [0, 1, 31, 500, 20_000])
def test_chunks_against_a_loop(size, monkeypatch):
    monkeypatch.setattr(chunking, "SEGMENT", 777)
    raw = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8)
    assert chunking.cut_points(raw, 64, 1024, 127) == _plain_chunks(raw.tobytes(), 64, 1024, 127)


def test_an_edit_repaints_few_chunks():
    raw = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)

    def chunks(x):
        ends = chunking.cut_points(x, 1024, 16384, 4095)
        return {hashlib.sha256(x[a:b].tobytes()).hexdigest() for a, b in zip([0, *ends], ends)}

    edited = np.concatenate([raw[:90_000], np.frombuffer(b"7 bytes", np.uint8), raw[90_000:]])
    assert len(chunks(raw) - chunks(edited)) <= 2


def test_slot_layout_is_a_prefix_sum(spark):
    lens = {"a": [3, 1, 4], "none": [], "null": None, "gap": [None, 2], "long": list(range(5000))}
    df = spark.createDataFrame([("f", p, v) for p, v in lens.items()], "folder_id string, path string, lens array<bigint>")
    got = {}
    for r in drift.slot_layout(df).orderBy("path", "slot").collect():
        got.setdefault(r.path, []).append((r.offset, r.length))
    assert got == {p: [(sum(x or 0 for x in v[:i]) if len(v) < 10 else i * (i - 1) // 2, v[i]) for i in range(len(v))] for p, v in lens.items() if v}


def test_scan_and_guard(spark, sides):
    local, _ = sides
    seen = spark.createDataFrame([("f", "a", 1, 1), ("f", "b", 2, 7), ("f", "new", 1, 1)], "folder_id string, path string, size bigint, mtime bigint")
    assert {r.path: r.change for r in scan.scan_diff(local, seen).collect()} == {"a": "same", "b": "candidate", "new": "new"}
    gone = scan.tombstones(local, seen, "A")
    assert {r.path: r.version["A"] for r in gone.collect()} == {"c": 2, "e": 2}
    identity = spark.createDataFrame([("f", "unknown")], "folder_id string, verdict string")
    ok, refused = scan.mass_delete_guard(gone, seen.limit(0), identity)
    assert ok.isEmpty() and refused.count() == 2


def test_git_changes(spark):
    out = spark.createDataFrame([("f", "R  new\0old\0?? dir/\0 M a b\0D  x\0")], "folder_id string, output string")
    got = {r.path: (r.status, r.orig_path, r.staged, r.dir) for r in commits.git_changes(out).collect()}
    assert got == {"new": ("renamed", "old", True, False), "dir": ("added", None, False, True), "a b": ("modified", None, False, False), "x": ("deleted", None, True, False)}


def test_git_entries_of_many_exports(spark):
    """Exports of one folder are parsed each for itself, and a long one in one pass."""
    long = "R  n\0o\0?? d/\0" * 50_000
    out = spark.createDataFrame([("f", 1, long), ("f", 2, "R  new\0old\0"), ("f", 3, "D  x\0"), ("f", 4, None), ("g", 1, "R  lost\0")], "folder_id string, export_id int, output string")
    got = {r.folder_id: (r.deleted, r.renamed, r.added, r.modified, r.staged) for r in commits.git_change_counts(commits.git_entries(out)).collect()}
    assert got == {"f": (1, 50_001, 50_000, 0, 50_002), "g": (0, 0, 0, 1, 1)}


def test_wire_round_trip(spark):
    odd = _m(spark, ('q"uote\\', {"A": 1, "é": 2}, 1, False, ["x"], 5), ("empty", {}, 0, True, [], None))
    sent = manifest.encode_manifest(odd).select("folder_id", F.concat(F.lit("["), "json", F.lit("]")).alias("body"))
    back = {r.path: (r.version, r.size, r.deleted, r.blocks, r.mtime) for r in manifest.decode_manifest(sent).collect()}
    assert back == {r.path: (r.version, r.size, r.deleted, r.blocks, r.mtime) for r in odd.collect()}


def test_shards(spark):
    rows = _m(spark, *[(f"p{i:03}", {"A": 1}, i, False, ["h" * (900 if i == 7 else 10)], 1) for i in range(40)])
    s = manifest.shard_manifest(rows, 600).collect()
    by = {}
    for r in s:
        by.setdefault(r.shard, []).append(r)
    assert len(s) == 40 and all(len(v) == 1 or sum(len(r.json) + 1 for r in v) + 1 <= 600 for v in by.values())


def test_chunk_reuse_by_one_shuffle(spark):
    """Reuse against plain sets, nulls and repeats included; no join, and as many tasks as are asked for."""
    rng = random.Random(8)
    slots = lambda files: [("f", p, i, rng.choice(["a", "b", "c", None]), rng.randint(1, 9)) for p in files for i in range(6)]
    r, l = slots("pqr"), slots("pqs")
    kind = "folder_id string, path string, slot int, hash string, length bigint"
    for by_position in (False, True):
        key = lambda x: x[1:4] if by_position else (x[1], x[3])
        have, want = {key(x) for x in l if x[3]}, {}
        for x in r:
            want.setdefault(x[1], [0, 0])[key(x) not in have] += x[4]
        out = chunking.chunk_reuse(spark.createDataFrame(r, kind), spark.createDataFrame(l, kind), by_position, 7)
        assert {x.path: [x.reused, x.sent] for x in out.collect()} == want
        plan = out._jdf.queryExecution().toString()
        assert "Join" not in plan and "REPARTITION_BY_NUM" in plan


def test_slots_are_dealt_by_their_number(spark, monkeypatch):
    from tidemark.plans import fixtures as fx

    monkeypatch.setattr(fx, "SLOTS_A_TASK", 500)
    tasks = fx.slot_tasks(spark, "/root/testdata/sf0.001")
    assert tasks >= 12 and fx.slots(spark, "/root/testdata/sf0.001", "local").rdd.getNumPartitions() == tasks


def test_a_part_is_packed_as_a_stream(spark):
    """Batches of a few rows, as Spark gives them of a large part: shards go on over batches, and no part is a group in memory."""
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(f, part, f"p{i:04}", rng.randint(1, 300)) for f in "fg" for part in (0, 1) for i in range(rng.randint(1, 400))]
    want = []
    for f, part in dict.fromkeys((f, part) for f, part, *_ in rows):
        shards = [[]]
        for n in (r[3] for r in rows if r[:2] == (f, part)):
            if shards[-1] and 2 + sum(shards[-1]) + n + len(shards[-1]) > 600:  # brackets, entries, commas
                shards.append([])
            shards[-1].append(n)
        want += [i for i, s in enumerate(shards) for _ in s]
    table = pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], ["folder_id", "part", "path", "bytes"])
    stream = manifest._shards(600)(iter(table.to_batches(max_chunksize=7)))
    first = next(stream)
    assert first.num_rows == 7
    assert [n for b in (first, *stream) for n in b.column(3).to_pylist()] == want and max(want) > 20
    s = manifest.shard_manifest(_m(spark, ("p", {"A": 1}, 1, False, [], 1)), 600)
    assert "FlatMapGroupsInPandas" not in s._jdf.queryExecution().toString()


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hi")
    (tmp_path / "sub" / "b.log").write_text("log")
    got = {r.path for r in files.scan_files(spark, str(tmp_path), "f").collect()}
    assert {"a.txt", "sub/b.log"} <= got
    assert "sub/b.log" not in {r.path for r in files.scan_files(spark, str(tmp_path), "f", parse_rules(["*.log"])).collect()}


@pytest.mark.parametrize("few_bytes", [rules.FEW_BYTES, 0])
def test_rule_files_are_the_composed_list(spark, few_bytes):
    """Verdicts by rule files against the whole list, rule by rule, on random trees."""
    rng = random.Random(few_bytes)
    name = lambda: rng.choice(["a", "b", "ab", "c.log", ".git", "d[1]"])
    line = lambda: rng.choice(["", "!"]) + rng.choice(["", "", "/"]) + rng.choice(["a", "b", "*.log", "a/b", "**/b", "a/**", "**", "*", "?b", "#x", "", "ab"]) + rng.choice(["", "", "/"])
    found = []
    for folder in "fghij":
        dirs = {""} | {"/".join(name() for _ in range(rng.randint(1, 3))) for _ in range(6)}
        found += [(folder, d, i, line() if rng.random() < 0.6 else " zz ") for d in dirs for i in range(rng.randint(1, 4))]
    lines = spark.createDataFrame(found, "folder_id string, dir string, line_no int, line string")
    paths = sorted({(f, "/".join(name() for _ in range(rng.randint(1, 5))), rng.random() < 0.3) for f in "fghijk" for _ in range(60)})
    df = spark.createDataFrame(paths, "folder_id string, path string, d boolean")
    own = ["*.log", "!c.log", "b/b"]
    out = rules.ignored_by_files(df, rules.rule_files(lines), own, F.col("d"), few_bytes=few_bytes).collect()
    listed = {}
    for r in rules.composed_rules(lines, own).orderBy("layer", "depth", "dir", "line_no").collect():
        listed.setdefault(r.folder_id, []).append(r.line)
    listed["k"] = [*builtin_lines(), *own]
    seen = set()
    for r in out:
        list_ = parse_rules(listed[r.folder_id])
        last = next((x for x in reversed(list_) if (y := rule_regex(x, r.d)) and re.match(y, r.path)), None)
        assert (r.rule is None) == (last is None) and (last is None or r.rule.negated == last.negated), (r, last)
        assert r.ignored == (bool(last and not last.negated) or ".git" in r.path.split("/"))
        seen.add((r.ignored, r.rule is None, bool(r.rule and r.rule.dir)))
    assert len(out) == len(paths) and len(seen) >= 4


def test_nested_lines_read_from_the_root(spark):
    said = ["x", "/x", "a/b", "!x/", "# c", "**", " "]
    lines = spark.createDataFrame([("f", "d", i, x) for i, x in enumerate(said)] + [("f", "", 0, "!x")], "folder_id string, dir string, line_no int, line string")
    out = [(r.layer, r.line) for r in rules.composed_rules(lines, ["own"]).orderBy("layer", "depth", "dir", "line_no").collect()]
    assert out[len(builtin_lines()) :] == [(1, "!x"), *((2, x) for x in ("d/**/x", "d/x", "d/a/b", "!d/**/x/", "# c", "d/**", " ")), (3, "own")]


def test_rule_files_in_shut_directories(spark):
    found = [("f", "", 0, "x/"), ("f", "x", 0, "!*"), ("f", "x/y", 0, "!*"), ("f", "a*", 0, "*"), ("f", ".git/b", 0, "*"), ("f", "ok", 0, "in/"), ("f", "ok/in", 0, "!*"), ("f", "ok/out", 0, "q")]
    files_ = rules.rule_files(spark.createDataFrame(found, "folder_id string, dir string, line_no int, line string"))
    assert sorted(r.dir for r in rules.active_rule_files(files_).collect()) == ["", "ok", "ok/out"]
    assert rules.active_rule_files(files_.limit(0)).isEmpty()


def test_fold_deltas(spark):
    current = _m(spark, ("a", {"A": 1}, 1, False, ["x"], 1), ("b", {"A": 1}, 1, False, ["x"], 1))
    deltas = _m(spark, ("a", {"A": 3}, 3, False, ["z"], 1), ("a", {"A": 2}, 2, False, ["y"], 1), ("b", {"B": 1}, 9, False, ["q"], 1), ("c", {"B": 1}, 5, False, ["n"], 1))
    deltas = deltas.withColumn("seq", F.when(F.col("size") == 3, 2).otherwise(1).cast("bigint"))
    got = {r.path: (r.version, r.size, r.conflict) for r in jobs.fold_deltas(current, deltas).collect()}
    assert got == {"a": ({"A": 3}, 3, False), "b": ({"A": 1, "B": 1}, 1, True), "c": ({"B": 1}, 5, False)}


def test_caps_are_per_folder(spark):
    rows = spark.createDataFrame([(f, f"p{i}") for f, n in (("f", 5), ("g", 2), ("h", 3)) for i in range(n)], "folder_id string, path string")
    out = [(r.folder_id, r.path, r.truncated) for r in common.truncated(rows, 3, "path").collect()]
    assert sorted(out) == [("f", f"p{i}", True) for i in range(3)] + [("g", f"p{i}", False) for i in range(2)] + [("h", f"p{i}", False) for i in range(3)]


def test_converged_is_plan_outcomes_and_landing(spark, sides):
    local, remote = sides
    p = plan.plan_full(local, remote)
    want = plan.apply_plan(local, p, plan.resolve_conflicts(p, "A"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(plan.converged(local, remote, "A")) == key(want)
