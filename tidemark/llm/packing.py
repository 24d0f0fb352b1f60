"""Packing of documents into fixed-length training sequences along a Hilbert curve.

Each document's words are hashed into a signed count vector, the vector is projected to a
few dimensions by a fixed random matrix, and the point's place on a Hilbert curve, with a
hash of doc_id and text below it, is its key; so a place that many share still spreads over
partitions. Documents are range-sorted by key. The ranges' bounds are quantiles, weighted by
length, of a bounded sample of keys (`SAMPLED` for each partition): they only balance the
partitions, whose number follows the input's bytes. Each partition packs its documents one
after another: neighbours on the curve share sequences. A task holds one open sequence, one
record batch and the ids of one document.

Documents are cut freely at sequence ends. What is left at a partition's end is dealt to
sequences whose lengths are powers of two, so that nothing is padded. A sequence id is
(partition, number within it); ids are unique, not consecutive.

Null and empty texts are the closing id alone. Repeated rows and rows with a null doc_id
are packed each for itself; a long text is cut over as many sequences as it needs; an empty
table gives no rows; further columns are left out whatever their names.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import of, spread
from ._text import chunks, hashes, utf8, words
from .bpe import PATTERN, Bpe, ship_vocabulary, vocabulary

WIDTH = 64  # of the hashed vectors
DIMS, BITS = 3, 12  # of the curve
TIE_BITS = 27  # of a key, below the curve's
PART_BYTES, MAX_PARTS, SAMPLED = 16 << 20, 20_000, 100  # texts of a partition; partitions; keys sampled for each


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integers below 2**bits.

    From the top bit down: where a coordinate's bit is set, the lower bits of the first
    coordinate are inverted, elsewhere they are exchanged; the bits, Gray-decoded across
    coordinates and interleaved, are the key.
    """
    x = points.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(len(x)):
            on = (x[d] >> b & 1).astype(bool)
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(len(x)):
            key = key << 1 | (x[d] >> b & 1)
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(7).normal(size=(WIDTH, DIMS))


def points(column: pa.Array) -> np.ndarray:
    """Grid points of texts: hashed word vectors, scaled to length 1 and projected."""
    out, matrix = [], _projection()
    for _, data, offsets in chunks(*utf8(column)):
        starts, ends, doc = words(data, offsets)
        h = hashes(data, starts, ends)
        n = len(offsets) - 1
        cell = doc * WIDTH + (h & np.uint64(WIDTH - 1)).astype(np.int64)
        sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
        v = np.bincount(cell, sign, n * WIDTH).astype(float).reshape(n, WIDTH)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        out.append(np.clip((v @ matrix + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))
    return np.concatenate(out) if out else np.zeros((0, DIMS), np.int64)


def _keys(text: pa.Array, tie: pa.Array) -> np.ndarray:
    place = hilbert_key(points(text), BITS).astype(np.uint64)
    tie = tie.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return (place << np.uint64(TIE_BITS) | tie >> np.uint64(64 - TIE_BITS)).view(np.int64)


def _sampled(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_keys(b.column(0), b.column(1))), b.column(2)], ["key", "size"])


def _dealt(bounds: np.ndarray):
    def run(batches):
        for b in batches:
            key = _keys(b.column(1), b.column(2))
            part = np.searchsorted(bounds, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array(part)], ["doc_id", "text", "key", "part"])

    return run


def range_sorted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of docs, in partitions that are ranges of the curve, each sorted along it."""
    docs = docs.withColumn("tie", F.xxhash64("doc_id", "text"))
    size = F.octet_length(F.coalesce("text", F.lit("")))
    total, rows = docs.agg(F.sum(size), F.count("*")).first()
    spread = min(docs.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // (1 << 20)))
    parts = min(max(1, spread, -(-(total or 0) // PART_BYTES)), MAX_PARTS)
    bounds = np.zeros(0, np.int64)
    if parts > 1:
        some = docs.sample(min(1.0, SAMPLED * parts / rows), 11).select("text", "tie", (size + 64).cast("long").alias("size"))
        cuts = F.percentile("key", [i / parts for i in range(1, parts)], F.col("size"))
        found = some.mapInArrow(_sampled, "key long, size long").agg(cuts.alias("cuts")).first().cuts
        bounds = np.array(found or [], float).astype(np.int64)
    keyed = docs.select("doc_id", "text", "tie").mapInArrow(_dealt(bounds), "doc_id long, text string, key long, part int")
    return keyed.repartitionById(parts, "part").sortWithinPartitions("key", "doc_id").select("doc_id", "text")


class _Compiled(Bpe):
    """The vocabulary with its merges done by a compiled library: same ids, on whole texts."""

    def __init__(self, source: bytes):
        super().__init__(source)
        import tiktoken

        special = set(self.specials.values())
        ranks = {s: i for i, s in enumerate(self.strings) if s and i not in special}
        self.encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def plain(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()


class Packer:
    """Deals out documents' ids to sequences; add() and close() give finished pieces."""

    def __init__(self, length: int, first: int, keep_ids: bool):
        self.length, self.sequence, self.keep = length, first, keep_ids
        self.open: list[tuple] = []
        self.used = 0

    def _piece(self, doc, start: int, ids: bytes, total: int, offset: int) -> tuple:
        return doc, start, len(ids) // 4, ids if self.keep else zlib.crc32(ids), total, self.sequence, offset

    def _flush(self):
        at = 0
        for doc, start, ids, total in self.open:
            yield self._piece(doc, start, ids, total, at)
            at += len(ids) // 4
        self.sequence += 1
        self.open, self.used = [], 0

    def add(self, doc, ids: bytes):
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.length - self.used)
            self.open.append((doc, start, ids[4 * start : 4 * (start + n)], total))
            self.used += n
            start += n
            if self.used == self.length:
                yield from self._flush()

    def close(self):
        left, self.open, self.used = self.open, [], 0
        n = sum(len(ids) for _, _, ids, _ in left) // 4
        while n:
            room = 1 << (n.bit_length() - 1)
            n -= room
            while room:
                doc, start, ids, total = left.pop(0)
                k = min(room, len(ids) // 4)
                self.open.append((doc, start, ids[: 4 * k], total))
                if 4 * k < len(ids):
                    left.insert(0, (doc, start + k, ids[4 * k :], total))
                room -= k
            yield from self._flush()


def _packed(shipped, length: int, close_id: int, keep_ids: bool):
    last = np.array([close_id], "<u4").tobytes()
    titles = ["doc_id", "start", "length", "ids" if keep_ids else "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def batch(rows):
        x = list(zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if keep_ids and i == 3 else pa.int64()) for i, v in enumerate(x)], titles)

    def run(batches):
        bpe = vocabulary(shipped, _Compiled)
        packer = Packer(length, TaskContext.get().partitionId() << 33, keep_ids)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows += packer.add(doc, bpe.packed(text.as_py() or "") + last)
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        rows += packer.close()
        if rows:
            yield batch(rows)

    return run


def pack(docs: DataFrame, vocabulary_path: str, length: int = 2048, close_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ids: the piece's token ids as little-endian 32-bit numbers; without keep_ids their
    CRC-32, as ids_crc32, stands instead.
    """
    shipped = ship_vocabulary(docs.sparkSession, vocabulary_path)
    dealt = range_sorted(spread(of(docs, doc_id="long", text="string")))
    kind = "ids binary" if keep_ids else "ids_crc32 long"
    return dealt.mapInArrow(_packed(shipped, length, close_id, keep_ids), f"doc_id long, start long, length long, {kind}, doc_tokens long, sequence_id long, offset long")
