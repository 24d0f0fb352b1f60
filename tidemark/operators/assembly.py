"""Files put together from received slots by tasks: hashed and written as a stream, no file in a row.

A file's expected hashes and its received slots go to one task, sorted by slot. The task checks each slot, hashes and
appends it to a file beside the target, and moves that in place only when every slot was there and right.
A task that runs again writes the same again.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import KEYS
from tidemark.session import shared_dir, ship_package

RESULT = "folder_id string, path string, size bigint, sha256 string, reason string"


class _File:
    """One file in the making; its rows come in order of slot, a slot's expected hash before its data."""

    def __init__(self, fs, base: str, key: tuple[str, str]):
        self.fs, self.key = fs, key
        self.target = f"{base}/{key[1]}"
        self.part = f"{self.target}.part-{uuid.uuid4().hex}"
        self.out = None
        self.sha, self.size = hashlib.sha256(), 0
        self.known = False
        self.want: str | None = None  # of the slot at hand, until it is written
        self.missing = self.wrong = False

    def expect(self, slot: int, hash_: str | None) -> None:
        self.missing |= self.want is not None
        self.known, self.want = True, hash_ if slot >= 0 else None

    def receive(self, slot: int, expected_slot: int, data: bytes, seen: str | None) -> None:
        """seen: the hash of this slot's copy that was written already; the same again is nothing new."""
        found = hashlib.sha256(data).hexdigest()
        if self.want is not None and found == self.want:
            if not (self.missing or self.wrong):
                self.append(data)
            self.want = None
        elif found != seen:
            self.wrong = self.wrong or slot == expected_slot
            if slot == expected_slot:
                self.want = None

    def append(self, data: bytes) -> None:
        if self.out is None:
            self.fs.create_dir(self.target.rpartition("/")[0], recursive=True)
            self.out = self.fs.open_output_stream(self.part)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.missing |= self.want is not None
        reason = "missing slots" if self.missing else "wrong hash" if self.wrong else None
        if reason is None and self.out is None:
            self.append(b"")
        if self.out is not None:
            self.out.close()
            if reason is None:
                self.fs.move(self.part, self.target)
            else:
                self.fs.delete_file(self.part)
        done = reason is None
        return *self.key, self.size if done else None, self.sha.hexdigest() if done else None, reason


def _assembled(roots: dict[str, str]):
    from tidemark.sources.tree import file_system

    def run(batches):
        opened, file, slot_, seen = {}, None, -1, None

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], ["folder_id", "path", "size", "sha256", "reason"])

        for b in batches:
            done = []
            for folder, path, slot, hash_, data in zip(*(b.column(i) for i in range(5))):
                key, slot = (folder.as_py(), path.as_py()), slot.as_py()
                if file is None or file.key != key:
                    done += [file.close()] if file and file.known else []
                    if key[0] not in opened:
                        opened[key[0]] = file_system(roots[key[0]])
                    file, slot_, seen = _File(*opened[key[0]], key), -1, None
                if not data.is_valid:
                    file.expect(slot, hash_.as_py())
                    slot_, seen = slot, hash_.as_py()
                elif file.known:
                    file.receive(slot, slot_, data.as_py(), seen)
            if done:
                yield batch(done)
        if file and file.known:
            yield batch([file.close()])

    return run


def assemble_files(slots: DataFrame, expected: DataFrame, roots: dict[str, str]) -> DataFrame:
    """(folder_id, path, size, sha256, reason) of expected files, which are written below their folder's root.

    slots: received (folder_id, path, slot, data), in any order and also repeated. expected: (folder_id, path, hashes). A file with
    missing slots, or else with data of a wrong hash, isn't written and has that as its reason. Slots of
    files that aren't expected, and slots past the last, are ignored. Runs at once; the result is kept in the shared folder.
    """
    spark = slots.sparkSession
    ship_package(spark)
    none = F.lit(None).cast("binary").alias("data")
    heads = expected.select(*KEYS, F.lit(-1).alias("slot"), F.lit(None).cast("string").alias("hash"), none)
    hashes = expected.select(*KEYS, F.posexplode("hashes").alias("slot", "hash"), none)
    data = slots.where("data is not null and slot >= 0").select(*KEYS, F.col("slot").cast("int").alias("slot"), F.lit(None).cast("string").alias("hash"), "data")
    rows = heads.unionByName(hashes).unionByName(data).repartition(*KEYS).sortWithinPartitions(*KEYS, "slot", F.col("data").isNotNull())
    where = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    rows.mapInArrow(_assembled(roots), RESULT).write.parquet(where)
    return spark.read.schema(RESULT).parquet(where)
