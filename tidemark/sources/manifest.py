"""Manifests in and out: stored rows, wire JSON, shards."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import chunk_view
from tidemark.operators.common import KEYS, as_manifest

WIRE = "array<struct<path:string,version:array<array<string>>,size:bigint,deleted:boolean,blocks:array<string>,cdh:array<string>,clens:array<bigint>,mtime:bigint>>"


def vector_of_json(text: Column | str) -> Column:
    """[["A",1],["B",2]] -> map; null or malformed text gives the empty vector."""
    pairs = F.coalesce(F.from_json(text, "array<array<string>>"), F.array().cast("array<array<string>>"))
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & F.get(p, 1).cast("bigint").isNotNull())
    return F.map_from_entries(F.transform(good, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).cast("bigint").alias("value"))))


def read_manifest(stored: DataFrame) -> DataFrame:
    """Manifest of stored rows whose version, blocks, cdh and clens are JSON text and deleted is 0 or 1.

    Lists of chunks that are malformed or of unequal length are no view, and the row stays;
    a time of 0 is none.
    """
    strings = lambda c: F.from_json(c, "array<string>")
    s = stored.withColumns({"_h": strings("cdh"), "_n": F.from_json("clens", "array<bigint>")})
    usable = chunk_view("_h", "_n")
    out = s.select(
        *KEYS,
        vector_of_json("version").alias("version"),
        F.col("size").cast("bigint").alias("size"),
        (F.col("deleted").cast("int") != 0).alias("deleted"),
        F.coalesce(strings("blocks"), F.array().cast("array<string>")).alias("blocks"),
        F.when(usable, F.col("_h")).alias("cdh"),
        F.when(usable, F.col("_n")).alias("clens"),
        F.nullif(F.col("mtime").cast("bigint"), F.lit(0)).alias("mtime"),
    )
    return as_manifest(out)


def decode_manifest(messages: DataFrame, column: str = "body") -> DataFrame:
    """Entries of wire messages (folder_id, body); unknown fields are dropped, bad chunk views too."""
    rows = messages.select("folder_id", F.inline(F.from_json(column, WIRE)))
    pairs = F.filter("version", lambda p: F.size(p) == 2)
    version = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.get(p, 0).alias("key"), F.get(p, 1).cast("bigint").alias("value"))))
    usable = chunk_view("cdh", "clens")
    return as_manifest(rows.withColumns({"version": version, "cdh": F.when(usable, F.col("cdh")), "clens": F.when(usable, F.col("clens"))}))


def entry_json(keep_time: bool = True) -> Column:
    """One entry as wire JSON. Vectors are [device, count] pairs, sorted by device."""
    pair = F.transform(F.array_sort(F.map_entries("version")), lambda e: F.concat(F.lit("["), F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(","), e["value"].cast("string"), F.lit("]")))
    vector = F.concat(F.lit("["), F.array_join(pair, ","), F.lit("]"))
    rest = F.to_json(F.struct("size", "deleted", "blocks", "cdh", "clens", *(["mtime"] if keep_time else [])))
    head = F.to_json(F.struct("path"))
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"version":'), vector, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))


def encode_manifest(manifest: DataFrame) -> DataFrame:
    """(folder_id, path, json) of every row but placeholders, which never leave a device."""
    return as_manifest(manifest).where("not placeholder").select(*KEYS, entry_json().alias("json"))


def _shards(limit: int):
    """Rows (folder_id, part, path, bytes) in that order, as a stream: of a part, a shard's number and bytes are kept."""

    def run(batches):
        key, shard, used = None, 0, 2
        for b in batches:
            found = []
            for *this, size in zip(*(b.column(i).to_pylist() for i in (0, 1, 3))):
                if this != key:
                    key, shard, used = this, 0, 2
                extra = size + (used > 2)
                if used > 2 and used + extra > limit:
                    shard, used, extra = shard + 1, 2, size
                used += extra
                found.append(shard)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(found, pa.int32())], ["folder_id", "part", "path", "shard_id"])

    return run


def shard_manifest(manifest: DataFrame, max_bytes: int = 8 << 20, part_rows: int = 50_000) -> DataFrame:
    """(folder_id, shard, path, json): entries packed in path order into shards whose encoding
    stays within max_bytes; a larger entry has a shard for itself.

    Packing is sequential, so only (path, bytes) are packed, in independent parts of about
    part_rows paths of a folder: a folder's last shard of each part may be less full. Spark sorts a part,
    and a task passes through it as a stream.
    """
    e = encode_manifest(manifest).withColumn("bytes", F.octet_length("json").cast("bigint"))
    sizes = e.groupBy("folder_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    sized = e.select(*KEYS, "bytes").join(sizes, "folder_id").withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    ordered = sized.select("folder_id", "part", "path", "bytes").repartition("folder_id", "part").sortWithinPartitions("folder_id", "part", "path")
    placed = ordered.mapInArrow(_shards(max_bytes), "folder_id string, part int, path string, shard_id int")
    return placed.join(e, KEYS).select("folder_id", F.concat_ws("-", F.col("part").cast("string"), F.col("shard_id").cast("string")).alias("shard"), "path", "json")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A new directory of Parquet by folder; directories are never changed in place."""
    as_manifest(manifest).write.mode("error").partitionBy("folder_id").parquet(path)


def read_manifest_jdbc(spark: SparkSession, url: str, table: str = "entries", **options: str) -> DataFrame:
    """Stored rows of a database table, for read_manifest(); needs a driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
