"""A streaming sink for alerts that commits each batch once, as a Python data source.

Tasks write Parquet parts; the driver's commit writes one small file that names a batch's parts, in its place at
once. Readers take what is named, so a batch that is run again replaces itself and parts of failed tasks are never seen.
The path may be on any file system that pyarrow opens by URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "tidemark-alerts"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class AlertWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _open(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        for b in iterator:
            if b.num_rows:
                if out is None:
                    fs.create_dir(f"{root}/parts", recursive=True)
                    out = pq.ParquetWriter(f"{root}/parts/{name}", b.schema, filesystem=fs)
                out.write_batch(b)
                rows += b.num_rows
        if out is not None:
            out.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        fs, root = _open(self.path)
        at = f"{root}/batches/{batchId:012}.json"
        fs.create_dir(f"{root}/batches", recursive=True)
        with fs.open_output_stream(f"{at}.tmp") as out:
            out.write("".join(json.dumps({"batch": batchId, "part": m.name}) + "\n" for m in messages if m and m.rows).encode())
        fs.move(f"{at}.tmp", at)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m and m.rows:
                fs.delete_file(f"{root}/parts/{m.name}")


class AlertSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema: StructType, overwrite: bool) -> AlertWriter:
        return AlertWriter(self.options["path"])


def read_alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Alerts of committed batches with their batch, to be ordered by (batch, ts)."""
    path = path.rstrip("/")
    named = spark.read.schema("batch bigint, part string").option("pathGlobFilter", "*.json").json(f"{path}/batches")
    rows = spark.read.schema(schema).parquet(f"{path}/parts").select("*", F.col("_metadata.file_name").alias("part"))
    return rows.join(named, "part").drop("part")
