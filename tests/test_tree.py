"""Walks and staged reading of real trees, byte-range chunks, assembly and history compaction on files."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.ignore import parse_rules
from tidemark.operators import rules, scan
from tidemark.sources import tree


def _write(root, **files):
    for path, data in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)


@pytest.fixture
def root(tmp_path):
    r = str(tmp_path / "data")
    _write(r, **{"a.txt": b"hi", "sub/b.log": b"log", "sub/.hidden": b"h", "skip/deep/x.txt": b"x", "inner/own.txt": b"o", "inner/more/z.txt": b"z", ".git/config": b"g", "sub/.gitignore": b"*.log\r\n!b.log\n", ".gitignore": b"skip/\n", "é ü/q.txt": b"", "keep/deep/y.txt": b"yy"})
    os.symlink(r, os.path.join(r, "sub", "loop"))
    os.symlink(os.path.join(r, "a.txt"), os.path.join(r, "link.txt"))
    return r


def test_a_walk_prunes(spark, root, monkeypatch):
    nested = spark.createDataFrame([("f", "inner"), ("g", "keep")], "folder_id string, dir string")
    files, dirs = tree.walk(spark, root, "f", parse_rules(["skip/"]), nested)
    got = {r.path: r.size for r in files.collect()}
    assert got == {"a.txt": 2, "sub/b.log": 3, "sub/.hidden": 1, "sub/.gitignore": 14, ".gitignore": 6, "é ü/q.txt": 0, "keep/deep/y.txt": 2}
    assert {r.path for r in dirs.collect()} == {"", "sub", "é ü", "keep", "keep/deep"}
    assert all(abs(r.mtime - os.path.getmtime(f"{root}/{r.path}") * 1000) < 1 for r in files.collect())
    lines = tree.rule_file_lines(files, {"f": root})
    assert {(r.dir, r.line_no, r.line) for r in lines.collect()} == {("", 0, "skip/"), ("", 1, ""), ("sub", 0, "*.log"), ("sub", 1, "!b.log"), ("sub", 2, "")}
    assert sorted(r.dir for r in rules.active_rule_files(rules.rule_files(lines)).collect()) == ["", "sub"]


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "{}/"])
def test_forms_of_roots(spark, root, form):
    files, _ = tree.walk(spark, form.format(root), "f", glob="*.txt")
    assert {r.path for r in files.collect()} == {"a.txt", "skip/deep/x.txt", "inner/own.txt", "inner/more/z.txt", "é ü/q.txt", "keep/deep/y.txt"}


def test_what_cannot_be_listed(spark, tmp_path):
    files, dirs = tree.walk(spark, str(tmp_path / "none"), "f")
    assert files.isEmpty() and [r.path for r in dirs.collect()] == [""]


def test_only_candidates_are_opened(spark, tmp_path):
    root = str(tmp_path)
    data = {p: p.encode() * n for p, n in {"same": 10, "touched": 700, "changed": 20, "sized": 30, "new": 5, "gone": 3, "empty": 0}.items()}
    _write(root, **data)
    listing, _ = tree.walk(spark, root, "f")
    listing = listing.cache()
    mtime = {r.path: r.mtime for r in listing.collect()}
    hashes = lambda d: [hashlib.sha256(d[i : i + 1000]).hexdigest() for i in range(0, len(d), 1000)]
    rows = [("f", p, len(d) + (p == "sized"), ["x"] if p == "changed" else hashes(d), mtime[p] - (p not in ("same",))) for p, d in data.items() if p != "new"]
    manifest = spark.createDataFrame(rows, "folder_id string, path string, size bigint, blocks array<string>, mtime bigint")
    diff = scan.scan_diff(manifest, listing, keep_blocks=True)
    os.remove(f"{root}/gone")
    os.remove(f"{root}/same")  # never opened, so nobody notices
    out = {r.path: (r.change, r.opened) for r in tree.settle_candidates(diff, {"f": root}, 1000).collect()}
    assert out == {"same": ("same", False), "touched": ("touched", True), "changed": ("changed", True), "sized": ("changed", False), "new": ("new", False), "gone": ("gone", False), "empty": ("touched", True)}
    assert tree.settle_candidates(diff.where(F.lit(False)), {}, 1000).isEmpty()


def test_files_are_written_by_tasks(spark, tmp_path):
    data = {"a": b"x" * 5000, "d/b": None, "d/é": b"\xff\n"}
    rows = spark.createDataFrame([("f", p, d) for p, d in data.items()], "folder_id string, path string, content binary").repartition(2)
    assert tree.write_files(rows, {"f": str(tmp_path)}) == (3, 5002)
    for p, d in data.items():
        assert (tmp_path / p).read_bytes() == (d or b"")
    assert {r.path for r in tree.walk(spark, str(tmp_path), "f")[0].collect()} == set(data)
    assert tree.write_files(rows.limit(0), {}) == (0, 0)


def test_documents_are_files_of_bounded_directories(spark, tmp_path, monkeypatch):
    """A directory for each document, and a task of the driver's commit for each, took hours at size."""
    from tidemark.plans import files as plans

    monkeypatch.setattr(plans, "shared_dir", lambda _: str(tmp_path))
    (tmp_path / "in").mkdir()
    spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 7 > 0 THEN repeat('ab', int(id)) END AS text").write.parquet(str(tmp_path / "in" / "documents.parquet"))
    out = {(r.change, r.opened): (r.files, r.bytes) for r in plans.scan_diff_by_content(spark, str(tmp_path / "in")).collect()}
    size = lambda *k: sum((2 * i if i % 7 else 0) + 1 for i in range(3000) if i % 5 in k)
    assert out == {("same", False): (600, size(0)), ("touched", True): (600, size(1)), ("changed", True): (600, size(2)), ("changed", False): (600, size(3)), ("new", False): (600, size(4))}
    (written,) = (tmp_path / "tree").iterdir()
    assert len(list(written.iterdir())) == 1024


@pytest.mark.parametrize("span", [1, 100, 5000, 1 << 20])
def test_chunks_by_ranges(spark, tmp_path, monkeypatch, span):
    """Files chunked by byte ranges against the same bytes as one cell each."""
    import numpy as np

    from tidemark.operators import chunking, ranges

    root, rng = str(tmp_path), np.random.default_rng(span)
    sizes = {"empty": 0, "one": 1, "flat": 3000, "x/a": 31, "x/b": 70_000 if span > 1 else 700, "c d": 9999 if span > 1 else 99}
    data = {p: bytes(n) if p == "flat" else rng.integers(0, 256, n).astype(np.uint8).tobytes() for p, n in sizes.items()}
    _write(root, **data)
    files, _ = tree.walk(spark, root, "f")
    content = spark.createDataFrame([("f", p, d) for p, d in data.items()], "folder_id string, path string, content binary")
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    found = ranges.cdc_chunks_of_files(files, {"f": root}, 64, 1024, 127, span)
    assert same(found, chunking.cdc_chunks(content, 64, 1024, 127)) and found.count() > 20
    assert same(ranges.fixed_blocks_of_files(files, {"f": root}, 333), chunking.fixed_blocks(content, 333))
    assert ranges.cdc_chunks_of_files(files.limit(0), {}).isEmpty()


def test_ranges_are_dealt_by_the_files_bytes(spark, tmp_path, monkeypatch):
    """Rows of a few bytes stand for much reading: their number of tasks must follow what is read."""
    from tidemark.operators import ranges

    _write(str(tmp_path), a=bytes(50_000), b=bytes(30_000))
    files, _ = tree.walk(spark, str(tmp_path), "f")
    monkeypatch.setattr(ranges, "TASK", 10_000)
    assert ranges._tasks(files) == 8 and ranges._tasks(files.limit(0)) == 4
    slots = ranges.fixed_blocks_of_files(files, {"f": str(tmp_path)}, 100)
    assert slots.select(F.spark_partition_id()).distinct().count() == 8 and slots.count() == 800
    assert ranges._ranges(files, 100, 8).select(F.spark_partition_id()).distinct().count() == 8


def _slots(spark, rows):
    return spark.createDataFrame([("f", p, i, bytearray(d)) for p, i, d in rows], "folder_id string, path string, slot int, data binary")


def test_assembly(spark, tmp_path):
    from tidemark.operators.assembly import assemble_files

    h = lambda b: hashlib.sha256(b).hexdigest()
    parts = {"ok": [b"ab", b"c"], "sub/same": [b"q", b"q", b"q"], "bad": [b"x"], "short": [b"s", b"t"], "empty": [], "late": [b"1", b"2"], "both": [b"m", b"n"]}
    got = [(p, i, d) for p, v in parts.items() for i, d in enumerate(v) if (p, i) not in {("short", 1), ("both", 1)}]
    got = [(p, i, b"y" if (p, i) in {("bad", 0), ("both", 0)} else d) for p, i, d in got]
    got += [("ok", 0, b"ab"), ("ok", 7, b"past"), ("stranger", 0, b"z"), ("late", 1, b"wrong copy")]
    want = spark.createDataFrame([("f", p, [h(d) for d in v]) for p, v in parts.items()], "folder_id string, path string, hashes array<string>")
    out = {r.path: (r.size, r.sha256, r.reason) for r in assemble_files(_slots(spark, got), want, {"f": str(tmp_path)}).collect()}
    good = {p: b"".join(parts[p]) for p in ("ok", "sub/same", "empty")}
    assert out == {p: (len(d), h(d), None) for p, d in good.items()} | {"bad": (None, None, "wrong hash"), "late": (None, None, "wrong hash"), "short": (None, None, "missing slots"), "both": (None, None, "missing slots")}
    found = {os.path.relpath(os.path.join(d, n), tmp_path): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(tmp_path) for n in names}
    assert found == good  # nothing half-written is left
    again = assemble_files(_slots(spark, got), want, {"f": str(tmp_path)})
    assert {r.path: (r.size, r.sha256, r.reason) for r in again.collect()} == out
    assert assemble_files(_slots(spark, got), want.limit(0), {"f": str(tmp_path)}).isEmpty()


def test_a_large_file_is_assembled_as_a_stream(spark, tmp_path):
    from tidemark.operators.assembly import assemble_files
    from tidemark.operators.ranges import fixed_blocks_of_files

    one = b"0123456789abcdef" * (1 << 16)
    slots = spark.range(200).select(F.lit("f").alias("folder_id"), F.lit("big").alias("path"), F.col("id").cast("int").alias("slot"), F.lit(bytearray(one)).alias("data")).repartition(8)
    want = spark.createDataFrame([("f", "big", [hashlib.sha256(one).hexdigest()] * 200)], "folder_id string, path string, hashes array<string>")
    out = assemble_files(slots, want, {"f": str(tmp_path)}).collect()
    assert [(r.size, r.reason) for r in out] == [(200 << 20, None)] and os.path.getsize(tmp_path / "big") == 200 << 20
    files = spark.createDataFrame([("f", "big", 200 << 20)], "folder_id string, path string, size bigint")
    assert {(r.length, r.hash) for r in fixed_blocks_of_files(files, {"f": str(tmp_path)}).collect()} == {(1 << 20, hashlib.sha256(one).hexdigest())}


def test_history_compaction(spark, tmp_path):
    from tidemark.sources import history_store as store

    base = str(tmp_path / "h")
    assert store.read_store(spark, base).isEmpty()
    events = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.concat(F.lit("f"), F.col("id") % 2).alias("folder_id"), F.concat(F.lit("p"), "id").alias("path"), *[F.lit("x").alias(c) for c in ("action", "direction", "device_id")])
    rows = lambda: sorted((r.folder_id, r.seq.n) for r in store.read_store(spark, base).collect())
    last = lambda n, limit: sorted((f"f{i % 2}", i) for i in range(n) if i >= n - 2 * limit)
    store.append_events(events(0, 30), base)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(f"{base}/{store.visible(base)[0]}/folder_id=f0")
    store.append_events(events(30, 40), base)
    assert rows() == last(40, 100)
    store.write_generation(spark, base, store.visible(base), 5)  # a compaction that stops here
    assert rows() == last(40, 100)
    names = store.visible(base)
    generation = store.write_generation(spark, base, names, 5)
    store.append_events(events(40, 44), base)  # comes in between
    os.makedirs(f"{base}/append-0-unfinished/folder_id=f0")  # and one that never ended
    store.publish(base, generation, names)
    assert rows() == sorted([*last(40, 5), *[(f"f{i % 2}", i) for i in range(40, 44)]])
    assert rows() == (store.publish(base, generation, names), rows())[1]
    store.compact_history(spark, base, 5)
    assert rows() == last(44, 5) and len(store.visible(base)) == 1
    dropped = store.drop_covered(base)
    assert len(dropped) == 5 and rows() == last(44, 5)
    store.compact_history(spark, base, 5)
    store.append_events(events(44, 46), base)
    store.compact_history(spark, base, 5)
    assert rows() == last(46, 5)
