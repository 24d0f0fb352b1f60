"""A store of sync events that is appended to and trimmed by compaction.

Each append is a directory of its own. CURRENT.json names a compacted generation and the directories that it covers;
readers take that generation and every append it doesn't cover. A compaction writes a new generation beside the
old one and then puts a new CURRENT.json in place by one rename, so readers see all of the old or all of
the new, appends in the meantime stay visible, and a compaction that stops half-way changes nothing and can be
repeated. Covered directories are deleted by drop_covered(), when no reader is at them any more.
"""

from __future__ import annotations

import json
import time
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import MAX_EVENTS, last_events
from tidemark.sources.tree import file_system

STORED = "ts timestamp, path string, action string, direction string, device_id string, n bigint, appended string, _corrupt_record string, folder_id string"
_COLUMNS = ("ts", "folder_id", "path", "action", "direction", "device_id")


def _new(kind: str) -> str:
    return f"{kind}-{time.time_ns():020}-{uuid.uuid4().hex[:8]}"


def append_events(events: DataFrame, base: str) -> str:
    """Appends events (seq, ts, folder_id, path, action, direction, device_id) as JSON lines by folder; gives the directory's name.

    Later appends are later in order; within one, seq decides.
    """
    name = _new("append")
    out = events.select(*_COLUMNS, F.col("seq").cast("bigint").alias("n"), F.lit(name).alias("appended"))
    out.write.partitionBy("folder_id").json(f"{base}/{name}")
    return name


def _current(base: str) -> dict:
    fs, at = file_system(base)
    if fs.get_file_info(f"{at}/CURRENT.json").type != pafs.FileType.File:
        return {"generation": None, "covers": []}
    with fs.open_input_stream(f"{at}/CURRENT.json") as f:
        return json.loads(f.read())


def visible(base: str) -> list[str]:
    """Names of the directories that readers take; only complete appends count."""
    fs, at = file_system(base)
    now = _current(base)
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.Directory and i.base_name.startswith("append-")]
    whole = [n for n in found if fs.get_file_info(f"{at}/{n}/_SUCCESS").type == pafs.FileType.File]
    return [*([now["generation"]] if now["generation"] else []), *sorted(set(whole) - set(now["covers"]))]


def _read(spark: SparkSession, base: str, names: list[str]) -> DataFrame:
    rows = None
    for name in names:  # partition columns are found below each base
        one = spark.read.schema(STORED).option("columnNameOfCorruptRecord", "_corrupt_record").option("basePath", f"{base}/{name}").json(f"{base}/{name}")
        rows = one if rows is None else rows.unionByName(one)
    rows = spark.createDataFrame([], STORED) if rows is None else rows
    good = rows.where(F.col("_corrupt_record").isNull() & F.col("path").isNotNull() & F.col("ts").isNotNull())
    return good.select(F.struct("appended", "n").alias("seq"), *_COLUMNS)


def read_store(spark: SparkSession, base: str) -> DataFrame:
    """(seq, ts, folder_id, path, action, direction, device_id); seq orders events by append. Bad lines are left out."""
    return _read(spark, base, visible(base))


def write_generation(spark: SparkSession, base: str, names: list[str], limit: int) -> str:
    """The last `limit` events of each folder in the named directories, as a new directory that nobody reads yet."""
    name = _new("generation")
    kept = last_events(_read(spark, base, names), limit)
    kept.select(*_COLUMNS, "seq.n", "seq.appended").write.partitionBy("folder_id").json(f"{base}/{name}")
    return name


def publish(base: str, generation: str, covers: list[str]) -> None:
    """Puts a generation in place of what it covers, by one rename."""
    fs, at = file_system(base)
    new = f"{at}/CURRENT.json.{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(json.dumps({"generation": generation, "covers": covers}).encode())
    fs.move(new, f"{at}/CURRENT.json")


def compact_history(spark: SparkSession, base: str, limit: int = MAX_EVENTS) -> str:
    """Trims each folder to its last `limit` events; safe to repeat at any time."""
    before, names = _current(base), visible(base)
    generation = write_generation(spark, base, names, limit)
    there = {i.base_name for i in file_system(base)[0].get_file_info(pafs.FileSelector(file_system(base)[1]))}
    publish(base, generation, sorted({*names, *before["covers"]} & there))
    return generation


def drop_covered(base: str) -> list[str]:
    """Deletes what the current generation covers and older generations; gives their names."""
    fs, at = file_system(base)
    now = _current(base)
    old = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name in now["covers"] or (i.base_name.startswith("generation-") and now["generation"] and i.base_name < now["generation"])]
    for name in old:
        fs.delete_dir(f"{at}/{name}")
    return old
