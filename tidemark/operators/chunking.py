"""Content in slots: fixed blocks, content-defined chunks, and what a transfer needs of them."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.common import KEYS

BLOCK = 1 << 20
#: Fixed values of the chunk layout; changing one changes every boundary.
MIN_CHUNK, MAX_CHUNK, MASK, SEED, WINDOW = 1 << 18, 1 << 22, (1 << 20) - 1, 0x9E3779B9, 32
SEGMENT = 1 << 22  # bytes fingerprinted at a time


def fixed_blocks(content: DataFrame, block: int = BLOCK) -> DataFrame:
    """(folder_id, path, slot, offset, length, hash) of (folder_id, path, content); nothing of empty files."""
    n = F.ceil(F.length("content") / block).cast("int")

    def one(i):  # inside the row, so no slot carries the content on
        piece = F.substring(F.col("content"), (i * block + 1).cast("int"), F.lit(block))
        return F.struct(i.alias("slot"), (i.cast("bigint") * block).alias("offset"), F.length(piece).cast("bigint").alias("length"), F.sha2(piece, 256).alias("hash"))

    slots = F.transform(F.sequence(F.lit(0), n - 1), one)
    return content.where(F.length("content") > 0).select(*KEYS, F.inline(slots))


@cache
def gear() -> np.ndarray:
    """One 32-bit number for each byte, from a small seeded generator in wrap-around arithmetic."""
    state = (np.uint64(SEED) + np.uint64(0x6D2B79F5) * np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)
    low = lambda x: x & np.uint64(0xFFFFFFFF)
    t = low((state ^ state >> np.uint64(15)) * (state | np.uint64(1)))
    t ^= low(t + low((t ^ t >> np.uint64(7)) * (t | np.uint64(61))))
    return low(t ^ t >> np.uint64(14)).astype(np.uint32)


def fingerprints(data: np.ndarray) -> np.ndarray:
    """Fingerprint of the last WINDOW bytes at each byte: the exclusive-or of the bytes' numbers,
    each rotated by its distance. A pure function of the window, so segments need no state.

    A window of 2 k bytes is one of k and the one before, rotated by k: five steps for WINDOW = 32."""
    out, k = gear()[data], 1
    while k < min(WINDOW, len(out)):
        x = out[:-k]
        x = x << np.uint32(k) | x >> np.uint32(32 - k)
        out[k:] ^= x
        k *= 2
    return out


def cut_points(data: np.ndarray, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = MASK) -> list[int]:
    """Ends of the chunks of a content: at a fingerprint with no bit of the mask once `least`
    bytes are in, at `most` bytes, or at the end."""
    marks = []
    for at in range(0, len(data), SEGMENT):
        lead = min(at, WINDOW - 1)
        f = fingerprints(data[at - lead : at + SEGMENT])[lead:]
        marks.append(at + 1 + np.flatnonzero((f & np.uint32(mask)) == 0))
    marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    marks, ends, start = marks.tolist(), [], 0
    while start < len(data):
        i = bisect_left(marks, start + least)
        stop = min(start + most, len(data))
        start = marks[i] if i < len(marks) and marks[i] < stop else stop
        ends.append(start)
    return ends


def _chunked(least: int, most: int, mask: int):
    def run(batches):
        for b in batches:
            ends, digests = [], []
            for cell in b.column(2):
                raw = cell.as_buffer() if cell.is_valid else pa.py_buffer(b"")
                found = cut_points(np.frombuffer(raw, np.uint8), least, most, mask)
                view = memoryview(raw)
                digests += [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip([0, *found], found)]
                ends.append(found)
            n = np.array([len(x) for x in ends], np.int64)
            row, stop = np.repeat(np.arange(len(n)), n), np.array([y for x in ends for y in x], np.int64)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = np.where(slot == 0, 0, np.roll(stop, 1))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(slot.astype(np.int32)), pa.array(start), pa.array(stop - start), pa.array(digests, pa.string())], [*KEYS, "slot", "offset", "length", "hash"])

    return run


def cdc_chunks(content: DataFrame, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = MASK) -> DataFrame:
    """(folder_id, path, slot, offset, length, hash) of content-defined chunks."""
    rows = content.select(*KEYS, F.col("content").cast("binary"))
    return rows.mapInArrow(_chunked(least, most, mask), "folder_id string, path string, slot int, offset bigint, length bigint, hash string")


def _lists(slots: DataFrame, *names: str) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("slot", "hash", "length")))
    cols = {"hashes": F.transform(order, lambda s: s["hash"]), "lengths": F.transform(order, lambda s: s["length"])}
    return slots.groupBy(*KEYS).agg(*[c.alias(n) for n, c in zip(names, cols.values())])


def file_views(content: DataFrame, block: int = BLOCK, least: int = MIN_CHUNK, most: int = MAX_CHUNK, mask: int = MASK) -> DataFrame:
    """(folder_id, path, size, blocks, cdh, clens): both layouts of each file."""
    fixed = _lists(fixed_blocks(content, block), "blocks")
    chunks = _lists(cdc_chunks(content, least, most, mask), "cdh", "clens")
    size = content.select(*KEYS, F.length("content").cast("bigint").alias("size"))
    out = size.join(fixed, KEYS, "left").join(chunks, KEYS, "left")
    return out.withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))


def verify_blocks(manifest: DataFrame, content: DataFrame, block: int = BLOCK) -> DataFrame:
    """(folder_id, path, ok): whether content still has the declared block list, its length included."""
    found = _lists(fixed_blocks(content, block), "found")
    j = manifest.select(*KEYS, "blocks").join(content.select(*KEYS, F.lit(True).alias("there")), KEYS, "left").join(found, KEYS, "left")
    none = F.array().cast("array<string>")
    return j.select(*KEYS, (F.coalesce("there", F.lit(False)) & (F.coalesce("found", none) == F.coalesce("blocks", none))).alias("ok"))


def missing_blocks(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote slots (folder_id, path, slot, hash, length) absent at the same place locally."""
    return remote.join(local.select(*KEYS, "slot", "hash"), [*KEYS, "slot", "hash"], "left_anti")


def first_chunk(local: DataFrame) -> DataFrame:
    """(folder_id, path, hash, slot, offset): where each chunk of a file first stands."""
    least = F.min(F.struct("slot", "offset")).alias("f")
    return local.groupBy(*KEYS, "hash").agg(least).select(*KEYS, "hash", "f.slot", "f.offset")


def chunk_sources(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote chunks with local_offset: where the same file's local version has them; null = missing."""
    have = first_chunk(local).select(*KEYS, "hash", F.col("offset").alias("local_offset"))
    return remote.join(have, [*KEYS, "hash"], "left")


def missing_chunks(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote chunks that the same file's local version has nowhere."""
    return remote.join(local.select(*KEYS, "hash"), [*KEYS, "hash"], "left_anti")


def shared_chunks(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(folder_id, path, hash) in both versions of a file."""
    return remote.select(*KEYS, "hash").intersect(local.select(*KEYS, "hash"))


def chunk_reuse(remote: DataFrame, local: DataFrame, by_position: bool, tasks: int | None = None) -> DataFrame:
    """(folder_id, path, reused, sent) bytes of a file's update; by position as fixed blocks are, or by hash.

    Both sides of a file meet in one shuffle and are added up by hash, then by file: no join, no sort.
    tasks: how many do so; Spark's number of shuffle partitions by default.
    """
    keys = [*KEYS, "slot", "hash"] if by_position else [*KEYS, "hash"]
    none = F.lit(None).cast("bigint")
    both = remote.select(*keys, F.col("length").cast("bigint").alias("length"), F.lit(True).alias("theirs")).unionByName(local.select(*keys, none.alias("length"), F.lit(False).alias("theirs")))
    both = both.repartition(tasks, *KEYS) if tasks else both.repartition(*KEYS)
    each = both.groupBy(*keys).agg(F.sum("length").alias("length"), F.bool_or("theirs").alias("theirs"), F.bool_or(~F.col("theirs")).alias("ours")).where("theirs")
    got = F.col("ours") & ~F.greatest(*[F.col(k).isNull() for k in keys])  # a null is equal to nothing
    return each.groupBy(*KEYS).agg(F.sum(F.when(got, F.col("length")).otherwise(0)).alias("reused"), F.sum(F.when(got, 0).otherwise(F.col("length"))).alias("sent"))


def partial_progress(layout: DataFrame, held: DataFrame, sizes: DataFrame) -> DataFrame:
    """(folder_id, path, slots_held, bytes_held) of files in flight. held: (folder_id, path, slot)."""
    j = layout.join(held.select(*KEYS, "slot").distinct(), [*KEYS, "slot"], "left_semi")
    each = j.groupBy(*KEYS).agg(F.count("*").alias("slots_held"), F.sum("length").alias("b"))
    return each.join(sizes.select(*KEYS, "size"), KEYS).select(*KEYS, "slots_held", F.least("b", "size").alias("bytes_held"))


def line_delta(old: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """(folder_id, path, added, removed): lines by bags, a lower bound of any line diff's counts."""
    lines = lambda df, n: df.select(*KEYS, F.explode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line"), F.lit(n).alias("d"))
    each = lines(new, 1).unionByName(lines(old, -1)).groupBy(*KEYS, "line").agg(F.sum("d").alias("d"))
    return each.groupBy(*KEYS).agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))
