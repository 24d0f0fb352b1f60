"""Chunking of files of any size: byte ranges over many tasks, no file in a cell or a task.

A fingerprint hangs on the last WINDOW bytes only, so possible cuts are found range by range, each read with WINDOW - 1
bytes before it. Only the choice among them goes through a file in order; it reads some eight bytes for
each mebibyte of the file, as a stream. Digests are made chunk by chunk again, in parallel.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunking import BLOCK, MASK, MAX_CHUNK, MIN_CHUNK, SEGMENT, WINDOW, fingerprints
from tidemark.operators.common import KEYS
from tidemark.session import ship_package

SPAN = 64 << 20  # bytes of a range
TASK = 64 << 20  # bytes of files that a task reads
TOGETHER = 32  # neighbouring chunks that one task digests
SLOTS = "folder_id string, path string, slot int, offset bigint, length bigint, hash string"


class _Files:
    """Files by (folder, path), one open at a time."""

    def __init__(self, roots: dict[str, str]):
        self.roots, self.at, self.file = roots, None, None

    def read(self, folder: str, path: str, start: int, length: int) -> bytes:
        from tidemark.sources.tree import file_system

        if self.at != (folder, path):
            self.close()
            fs, base = file_system(self.roots[folder])
            self.at, self.file = (folder, path), fs.open_input_file(f"{base}/{path}")
        self.file.seek(start)
        data = self.file.read(length)
        if len(data) != length:
            raise OSError(f"{path}: {len(data)} of {length} bytes at {start}; the file has changed since it was listed")
        return data

    def close(self) -> None:
        if self.file:
            self.file.close()


def _tasks(files: DataFrame) -> int:
    """How many tasks read the files. Ranges and slots are a few bytes each, so Spark would put thousands of them into one."""
    (size,) = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK))


def _ranges(files: DataFrame, span: int, tasks: int) -> DataFrame:
    """(folder_id, path, size, at, length): each file's ranges; none of empty files. Neighbouring short ranges are read by one task."""
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(span).cast("bigint"))).alias("at")
    rows = files.where("size > 0").select(*KEYS, "size", at)
    return rows.withColumn("length", F.least(F.lit(span).cast("bigint"), F.col("size") - F.col("at"))).repartition(tasks, *KEYS, F.floor(F.col("at") / max(span, TASK // TOGETHER)))


def _marked(roots: dict[str, str], mask: int):
    def run(batches):
        files = _Files(roots)
        for b in batches:
            for folder, path, size, at, length in zip(*(b.column(i).to_pylist() for i in range(5))):
                marks = []
                for start in range(at, at + length, SEGMENT):
                    lead = min(start, WINDOW - 1)
                    n = min(SEGMENT, at + length - start)
                    found = fingerprints(np.frombuffer(files.read(folder, path, start - lead, lead + n), np.uint8))[lead:]
                    marks.append(start + 1 + np.flatnonzero((found & np.uint32(mask)) == 0))
                marks = np.concatenate(marks)
                values = pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), pa.array(marks, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([path]), pa.array([size]), pa.array([at]), values], [*KEYS, "size", "at", "marks"])
        files.close()

    return run


def _chosen(least: int, most: int, span: int):
    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], [*KEYS, "slot", "offset", "length"])

        out, key, start, slot = [], None, 0, 0
        for b in batches:
            for folder, path, size, at, marks in zip(*(b.column(i) for i in range(5))):
                this = folder.as_py(), path.as_py()
                if this != key:
                    key, start, slot = this, 0, 0
                size, marks, at = size.as_py(), marks.values.to_pylist() if marks.is_valid else [], at.as_py()
                end, i = min(size, at + span), 0
                while start < size:
                    i = bisect_left(marks, start + least, i)
                    stop = min(start + most, size)
                    cut = marks[i] if i < len(marks) and marks[i] < stop else stop
                    if cut > end:  # what cuts here stands in the next range
                        break
                    out.append((*key, slot, start, cut - start))
                    start, slot = cut, slot + 1
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    return run


def _digested(roots: dict[str, str]):
    def run(batches):
        files = _Files(roots)
        for b in batches:
            found = [hashlib.sha256(files.read(*row)).hexdigest() for row in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(found, pa.string())], [*KEYS, "slot", "offset", "length", "hash"])
        files.close()

    return run


def _with_digests(slots: DataFrame, roots: dict[str, str], tasks: int) -> DataFrame:
    dealt = slots.repartition(tasks, *KEYS, F.floor(F.col("slot") / TOGETHER)).sortWithinPartitions(*KEYS, "slot")
    return dealt.select(*KEYS, "slot", "offset", "length").mapInArrow(_digested(roots), SLOTS)


def cdc_chunks_of_files(files: DataFrame, roots: dict[str, str], least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = MASK, span: int = SPAN) -> DataFrame:
    """(folder_id, path, slot, offset, length, hash) of files (folder_id, path, size): as cdc_chunks() of their content.

    roots: where each folder's files lie. A file that has become shorter since it was listed is an error.
    """
    ship_package(files.sparkSession)
    tasks = _tasks(files)
    marks = _ranges(files, span, tasks).select(*KEYS, "size", "at", "length").mapInArrow(_marked(roots, mask), "folder_id string, path string, size bigint, at bigint, marks array<bigint>")
    marks = marks.repartition(*KEYS).sortWithinPartitions(*KEYS, "at")
    return _with_digests(marks.mapInArrow(_chosen(least, most, span), "folder_id string, path string, slot int, offset bigint, length bigint"), roots, tasks)


def fixed_blocks_of_files(files: DataFrame, roots: dict[str, str], block: int = BLOCK) -> DataFrame:
    """(folder_id, path, slot, offset, length, hash) of files (folder_id, path, size): as fixed_blocks() of their content."""
    ship_package(files.sparkSession)
    at = F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(block).cast("bigint"))).alias("slot", "offset")
    slots = files.where("size > 0").select(*KEYS, "size", at)
    return _with_digests(slots.withColumn("length", F.least(F.lit(block).cast("bigint"), F.col("size") - F.col("offset"))), roots, _tasks(files))
