"""Keyed streaming state: processors against ordered folds, however a stream is cut, and runs through Spark."""

from __future__ import annotations

import datetime
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators.common import KEYS, MANIFEST
from tidemark.streaming import jobs, state


class Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v

    def clear(self):
        self.v = None


class Listed:
    def __init__(self):
        self.v = []

    def appendList(self, rows):
        self.v += rows

    def put(self, rows):
        self.v = list(rows)

    get = lambda self: iter(self.v)
    clear = lambda self: self.v.clear()


class Handle:
    def __init__(self):
        self.timers = set()

    getValueState = lambda self, *_: Value()
    getListState = lambda self, *_: Listed()
    listTimers = lambda self: iter(list(self.timers))
    registerTimer = lambda self, t: self.timers.add(t)
    deleteTimer = lambda self, t: self.timers.discard(t)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    getCurrentWatermarkInMs = lambda self: self.ms


def _run(processor, rows, cuts, delay_ms=5):
    """One key's rows (with us) in triggers cut as given, then all timers."""
    handle, out, mark = Handle(), [], 0
    processor.init(handle)
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        if lo < hi:
            out += processor.handleInputRows(("f", "p"), iter(rows[lo:hi]), Watermark(mark))
            mark = max(mark, max(r["us"] for r in rows[:hi]) // 1000 - delay_ms)
        for t in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(t)
            out += processor.handleExpiredTimer(("f", "p"), Watermark(mark), t)
    while handle.timers:
        t = handle.timers.pop()
        out += processor.handleExpiredTimer(("f", "p"), Watermark(1 << 40), t)
    return out


def _cuts(rng, n):
    return sorted(rng.sample(range(n), rng.randint(0, min(n, 8))))


def _late(rng, rows):
    """Rows in an order of arrival up to 4 ms off."""
    return sorted(rows, key=lambda r: r["us"] + rng.randint(0, 4000))


@pytest.mark.parametrize("seed", range(30))
def test_completions_do_not_hang_on_cuts(seed):
    rng = random.Random(seed)
    rows = [Row(us=rng.randint(0, 30_000), busy=rng.random() < 0.5) for _ in range(40)]
    order = sorted((r["us"], r["busy"]) for r in rows)
    want = [b[0] for a, b in zip(order, order[1:]) if a[1] and not b[1]]
    assert [r["us"] for r in _run(state.Completions(), _late(rng, rows), _cuts(rng, 40))] == want
    assert any(_run(state.Completions(), rows, []))  # a control


@pytest.mark.parametrize("seed", range(30))
def test_claims_do_not_hang_on_cuts(seed):
    rng = random.Random(seed)
    rows = [Row(us=rng.randint(0, 30_000), seq=i, version_key=rng.choice("kj"), link=rng.choice("abc"), released=rng.random() < 0.2) for i in range(60)]
    held, want = None, []
    for r in sorted(rows, key=lambda r: (r["us"], r["seq"])):
        mine = (r["version_key"], r["link"])
        if r["released"]:
            held = None if held and held[:2] == mine else held
        elif not (held and held[0] == mine[0] and held[1] != mine[1] and r["us"] - held[2] < 6000):
            held = (*mine, r["us"])
            want.append(r["seq"])
    got = [r["seq"] for r in _run(state.Claims(6000), _late(rng, rows), _cuts(rng, 60))]
    assert got == want and 0 < len(want) < 60


def test_kept_rows_are_packed():
    """Elements of state, not rows: each cost as much as a thousand; packs that a timer does not reach stay as they are."""
    import pandas as pd

    rng, handle = random.Random(2), Handle()
    p = state.Completions()
    p.init(handle)
    rows = [(rng.randint(0, 90_000), rng.choice([True, False, None])) for _ in range(5000)]
    frames = [pd.DataFrame(rows[i : i + 1000], columns=["us", "busy"]) for i in range(0, 4000, 1000)]
    assert list(state.Framed(p).handleInputRows(("f",), iter(frames), Watermark(0))) == []
    p.handleInputRows(("f",), iter([Row(us=us + 200_000, busy=b) for us, b in rows[4000:]]), Watermark(0))
    assert len(p.waiting.v) == 5
    last = p.waiting.v[4]
    out = list(state.Framed(p).handleExpiredTimer(("f",), Watermark(60), None))
    order = sorted((r for r in rows[:4000] if r[0] < 60_000), key=lambda r: (r[0], r[1] is not None, bool(r[1])))
    want = [b[0] for a, b in zip(order, order[1:]) if a[1] and b[1] is False]
    assert [us for f in out for us in f["us"]] == want and len(want) > 200
    assert len(p.waiting.v) == 5 and last in p.waiting.v


def test_deltas_come_as_frames():
    """A trigger's deltas of a path as frames, in any order; what a row only passes on is one column."""
    import pandas as pd

    p = state.FoldDeltas()
    p.init(Handle())
    row = lambda seq, rest, **v: (seq, [*v], [*v.values()], rest)
    frame = lambda *rows: pd.DataFrame(rows, columns=["seq", *state.FLAT])
    (out,) = p.handleInputRows(("f", "p"), iter([frame(row(3, "c", A=1, B=1), row(1, "a", A=1)), frame(row(2, "b", A=2))]), None)
    assert out.values.tolist() == [["f", "p", ["A", "B"], [2, 1], "b", True]]
    assert list(p.handleInputRows(("f", "p"), iter([frame(row(4, "d", A=2))]), None)) == []
    (out,) = p.handleInputRows(("f", "p"), iter([frame(row(5, "e", A=2, B=2))]), None)
    assert out.rest.tolist() == ["e"] and not out.conflict[0]


def test_changes_of_a_key():
    p = state.Changes()
    p.init(Handle())
    said = lambda *rows: [(r["us"], r["status"]) for r in p.handleInputRows(("k",), iter([Row(us=u, status=s) for u, s in rows]), None)]
    assert said((1, "x"), (3, "y"), (2, "z")) == [(3, "y")] and said((5, "y")) == [] and said((6, "y"), (6, "z")) == [(6, "z")]
    assert said((7, None)) == [(7, None)] and said((8, None)) == [] and said((None, "q"), (9, "z")) == [(9, "z")]


def test_alerts_commit_once(spark, tmp_path):
    from tidemark.streaming import sink

    base, schema = str(tmp_path), "ts timestamp, action string, folder_id string, path string"
    kinds = ["conflict", "error", "completed", "update"]
    for k in range(2):
        spark.createDataFrame([(_ts(10 * k + i), kinds[i % 4], "f", str(i)) for i in range(8)], schema).write.mode("append").parquet(f"{base}/in")
        jobs.alerts(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c").awaitTermination()
    read = lambda: sorted((r.batch, r.ts, r.kind) for r in sink.read_alerts(spark, f"{base}/out", "ts timestamp, kind string, folder_id string, path string").collect())
    before = read()
    assert [b for b, *_ in before] == [0] * 6 + [1] * 6 and {k for *_, k in before} == set(kinds[:3])
    os.remove(f"{base}/c/commits/1")  # as if the driver had stopped before it noted the batch
    os.path.exists(f"{base}/c/commits/.1.crc") and os.remove(f"{base}/c/commits/.1.crc")
    jobs.alerts(spark.readStream.schema(schema).parquet(f"{base}/in"), f"{base}/out", f"{base}/c").awaitTermination()
    assert read() == before and len(os.listdir(f"{base}/out/parts")) > len({p for p in os.listdir(f"{base}/out/batches")})
    writer = sink.AlertWriter(f"{base}/out")
    import pyarrow as pa

    part = writer.write(iter([pa.RecordBatch.from_pydict({"ts": pa.array([0], pa.timestamp("us", "UTC")), "kind": ["error"], "folder_id": ["f"], "path": ["x"]})]))
    assert part.name in os.listdir(f"{base}/out/parts") and read() == before  # not committed
    writer.abort([part, None], 7)
    assert part.name not in os.listdir(f"{base}/out/parts")


def _ts(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=n)


def _stream(spark, base, df):
    return spark.readStream.schema(df.schema).parquet(f"{base}/in")


def test_deltas_over_triggers(spark, tmp_path):
    """Keyed state gives what the batch fold gives, and a trigger writes only what it changed."""
    rng, base = random.Random(5), str(tmp_path)
    schema = "folder_id string, path string, seq bigint, version map<string,bigint>, size bigint, deleted boolean, blocks array<string>"
    initial = spark.createDataFrame([("f", p, 0, {"A": 1}, 1, False, ["x"]) for p in "abcz"], schema).drop("seq")
    rows = [("f", rng.choice("abcde"), i, {d: rng.randint(1, 4) for d in rng.sample("ABC", rng.randint(1, 3))}, i, rng.random() < 0.1, [str(i)]) for i in range(60)]
    rows.append(("f", "b", 60, None, 5, None, None))
    deltas = spark.createDataFrame(rows, schema)
    for k in range(4):
        deltas.where(F.col("seq").between(k * 16, k * 16 + 15)).write.mode("append").parquet(f"{base}/in")
        jobs.apply_deltas(_stream(spark, base, deltas), initial, f"{base}/out", f"{base}/c").awaitTermination()
    cols = [*KEYS, *MANIFEST, "conflict"]
    plain = lambda df: sorted(str([sorted(v.items()) if isinstance(v, dict) else v for v in r]) for r in df.select(*cols).collect())
    got = jobs.current_manifest(initial, f"{base}/out")
    assert plain(got) == plain(jobs.fold_deltas(initial, deltas))
    assert any(r.conflict for r in got.collect())
    written = spark.read.parquet(f"{base}/out")
    assert "z" not in {r.path for r in written.collect()} and written.groupBy(*KEYS, "batch").count().where("count > 1").isEmpty()
    before = {b: plain(written.where(f"batch <= {b}")) for b in (0, 1)}
    assert before[0] != before[1]
    n = written.count()
    jobs.apply_deltas(_stream(spark, base, deltas), initial, f"{base}/out", f"{base}/c").awaitTermination()  # nothing new
    assert spark.read.parquet(f"{base}/out").count() == n
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != state.ROCKSDB


@pytest.mark.parametrize("name", ["completed_folders", "single_flight"])
def test_late_rows_are_dropped(spark, tmp_path, name):
    base = str(tmp_path)
    if name == "completed_folders":
        schema = "folder_id string, ts timestamp, busy boolean"
        pieces = [[("f", _ts(100), True), ("f", _ts(160), False)], [("f", _ts(130), False), ("f", _ts(400), True)], [("f", _ts(90), False), ("f", _ts(2000), False)], [("g", _ts(4000), True)]]
        want = [130, 2000]  # the row of 130 came in time, that of 90 came after the watermark had passed it
    else:
        schema = "folder_id string, path string, ts timestamp, seq bigint, version_key string, link string, released boolean"
        row = lambda t, link, released=False: ("f", "p", _ts(t), t, "k", link, released)
        pieces = [[row(100, "a"), row(120, "b")], [row(110, "a", True), row(400, "a")], [row(50, "z"), row(2000, "c")], [row(4000, "d")]]
        want = [100, 120, 400, 2000]  # b goes on since a's release came in time; c's and a's claims ran out
    for piece in pieces:
        spark.createDataFrame(piece, schema).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        job = jobs.completed_folders(stream, f"{base}/out", f"{base}/c", "1 minute") if name == "completed_folders" else jobs.single_flight(stream, f"{base}/out", f"{base}/c", 200, "1 minute")
        job.awaitTermination()
    out = sorted(round((r.ts - _ts(0)).total_seconds()) for r in spark.read.parquet(f"{base}/out").collect())
    assert out == want
    assert os.path.isdir(f"{base}/out/_spark_metadata")
