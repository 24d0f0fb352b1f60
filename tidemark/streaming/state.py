"""Stateful processors: what a stream keeps for each key between triggers, in a RocksDB state store.

A processor gets a key's rows of a trigger in no particular order. FoldDeltas sorts them by seq and folds them
at once. The others wait: rows are kept until the watermark has passed them and are then
taken in order of event time, so what comes out doesn't hang on how the stream was cut into triggers.
Kept rows are packed as Arrow batches, some ten thousands in an element of state, since an element costs about as much as a thousand rows.
Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.common import MANIFEST

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def relation(a: dict, b: dict) -> str:
    """compare_versions() of two plain vectors."""
    keys = {*a, *b}
    over, under = (all(x.get(k, 0) >= y.get(k, 0) for k in keys) for x, y in ((a, b), (b, a)))
    return "equal" if over and under else "a-newer" if over else "b-newer" if under else "concurrent"


def merged(a: dict, b: dict) -> dict:
    return {k: max(a.get(k, 0), b.get(k, 0)) for k in sorted({*a, *b})}


_REST = {c: k for c, k in MANIFEST.items() if c != "version"}
#: A manifest row as processors take and give it: its vector as two lists, since Arrow has no maps for them, and the rest, which they only pass on, as JSON.
FLAT = ("devices", "counts", "rest")
FOLDED = "devices array<string>, counts array<bigint>, rest string, conflict boolean"
REST = ", ".join(f"{c} {k}" for c, k in _REST.items())


def flat(df: DataFrame, *keys: str) -> DataFrame:
    """(*keys, *FLAT) of a manifest."""
    v = F.coalesce("version", F.expr("cast(map() as map<string,bigint>)"))
    return df.select(*keys, F.map_keys(v).alias("devices"), F.map_values(v).alias("counts"), F.to_json(F.struct(*_REST)).alias("rest"))


class FoldDeltas(StatefulProcessor):
    """The manifest row of a path; a row goes out in each trigger that changes it.

    A newer version replaces, an older one is ignored, a concurrent one keeps the row with the merged
    vector and marks it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", FOLDED)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        devices, counts, rest = (initialState[c].iloc[0] for c in FLAT)
        self.row.update(([*devices], [*map(int, counts)], rest, False))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = before = tuple(self.row.get()) if self.row.exists() else None
        ours = dict(zip(*now[:2])) if now else None
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for devices, counts, rest in zip(*(new[c] for c in FLAT)):
            theirs = dict(zip(devices, map(int, counts)))
            how = "b-newer" if ours is None else relation(ours, theirs)
            if how == "b-newer":
                ours, now = theirs, ([*theirs], [*theirs.values()], rest, False)
            elif how == "concurrent":
                ours = merged(ours, theirs)
                now = ([*ours], [*ours.values()], now[2], True)
        if now != before:
            self.row.update(now)
            yield pd.DataFrame([(*key, *now)], columns=["folder_id", "path", *FLAT, "conflict"])

    def close(self) -> None:
        pass


class Changes(StatefulProcessor):
    """A row for each trigger whose newest status of a key, by (us, status), differs from the last one put out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        us, status = max(((r["us"], r["status"]) for r in rows), key=lambda x: tuple((v is not None, v) for v in x))
        if not self.last.exists() or self.last.get()[0] != status:
            self.last.update((status,))
            yield Row(key=key[0], us=us, status=status)

    def close(self) -> None:
        pass


PACKED = 50_000  # rows of an element of state
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _sorted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows by all columns, nulls first; texts, which repeat, as dictionaries."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(n, "ascending") for n in rows.schema.names], null_placement="at_start"))
    return pa.RecordBatch.from_arrays([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in rows.columns], rows.schema.names)


def _pack(rows: pa.RecordBatch) -> tuple[int, int, bytes]:
    """(first, last, rows): sorted rows with us first."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as to:
        to.write_batch(rows)
    us = rows.column(0)
    return us[0].as_py(), us[len(us) - 1].as_py(), out.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pa.RecordBatch:
    (rows,) = pa.ipc.open_stream(packed)
    return rows


def _nulls_first(row: tuple) -> tuple:
    return tuple((v is not None, v) for v in row)


def _in_order(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of sorted batches, all in order; of each batch some thousand are Python's at a time."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for at in range(0, b.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 1000).columns))

    return merge(*map(rows, batches), key=_nulls_first if any(c.null_count for b in batches for c in b.columns) else None)


class InEventTime(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them; step() then gets them in order of time.

    Subclasses name the kept columns (`kept`, ts as microseconds first) and what they remember (`memory`). Of the kept rows
    there is one timer, at the earliest. Rows wait packed, each pack sorted, with its first and last time; a timer
    opens only packs that it reaches, and merges them.
    """

    kept = memory = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first bigint, last bigint, rows binary")
        self.known = handle.getValueState("known", self.memory)
        self.schema = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in self.kept.split(","))])

    def row(self, r: Row | pd.DataFrame) -> tuple:
        """The kept columns of a row, or of a frame of rows."""
        raise NotImplementedError

    def step(self, key, known: tuple | None, row: tuple) -> tuple[tuple | None, list[Row]]:
        """(what to remember, what to put out) for the next row in time; None forgets."""
        raise NotImplementedError

    def _packs(self, rows: Iterable[Row] | Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, bytes]]:
        rows = iter(rows)
        while new := list(islice(rows, 1)):
            if isinstance(new[0], pd.DataFrame):
                columns = self.row(new[0])
            else:
                columns = zip(*map(self.row, [*new, *islice(rows, PACKED - 1)]))
            yield _pack(_sorted(pa.RecordBatch.from_arrays([pa.array(c, f.type, from_pandas=True) for c, f in zip(columns, self.schema)], schema=self.schema)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = list(self._packs(rows))
        self.waiting.appendList(new)
        self._timer(min(first for first, *_ in new))
        return iter(())

    def _timer(self, micros: int) -> None:
        """At the millisecond behind micros, if there is none before."""
        at, set_ = micros // 1000 + 1, list(self.handle.listTimers())
        if not set_ or at < min(set_):
            for t in set_:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = 1000 * timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for pack in self.waiting.get():
            if pack[0] >= until:
                rest.append(tuple(pack))
                continue
            rows = _unpack(pack[2])
            n = int(np.searchsorted(rows.column(0).to_numpy(), until))
            due.append(rows.slice(0, n))
            if n < rows.num_rows:
                rest.append(_pack(rows.slice(n)))
        before = known = tuple(self.known.get()) if self.known.exists() else None
        for r in _in_order(due):
            known, out = self.step(key, known, r)
            yield from out
        if known is None:
            self.known.clear()
        elif known != before:
            self.known.update(known)
        if rest:
            self.waiting.put(rest)
            self._timer(min(first for first, *_ in rest))
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


class Framed(StatefulProcessor):
    """An InEventTime processor for transformWithStateInPandas: Spark makes frames of rows much faster than it makes single ones, above all of their timestamps."""

    def __init__(self, of: InEventTime):
        self.of = of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of.init(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self.of.handleInputRows(key, rows, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self.of.handleExpiredTimer(key, timerValues, expiredTimerInfo)
        while out := list(islice(rows, 10_000)):
            yield pd.DataFrame(out, columns=out[0].__fields__)

    def close(self) -> None:
        pass


class Completions(InEventTime):
    """A row whenever a folder goes from moving to idle. Rows of one time: idle first."""

    kept, memory = "us bigint, busy boolean", "busy boolean"

    def row(self, r: Row) -> tuple:
        return r["us"], r["busy"]

    def step(self, key, known, row):
        us, busy = row
        return (busy,), [Row(folder_id=key[0], us=us)] if known and known[0] and busy is False else []


class Claims(InEventTime):
    """Offers of a path that may go on. An offer takes the path for `ttl` microseconds, or until its link
    releases that version; meanwhile, the same version from another link is left out."""

    kept, memory = "us bigint, seq bigint, version_key string, link string, released boolean", "version_key string, link string, us bigint"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def row(self, r: Row) -> tuple:
        return r["us"], r["seq"], r["version_key"], r["link"], r["released"]

    def step(self, key, known, row):
        us, seq, version, link, released = row
        if released:
            return (None if known and known[:2] == (version, link) else known), []
        if known and known[0] == version and known[1] != link and us - known[2] < self.ttl:
            return known, []
        return (version, link, us), [Row(folder_id=key[0], path=key[1], version_key=version, link=link, us=us, seq=seq)]
