"""Removal of word windows that already occur in a document with a smaller doc_id.

1. Every window of `window` words has an anchor, the least hash of the k-word grams in it
   (k about half the window), so equal windows have equal anchors and an anchor occurs in at
   least as many documents as any window it stands for. Each map task counts anchors, once
   for each document, in a count-min sketch of two rows of saturating cells (0, 1, many); it
   sends the cells it touched, sorted and compressed. Sketches are merged in two levels by
   shard, streaming, and only the bits "many" are kept: tasks write them, compressed, to the
   shared folder, from where Spark brings them to each executor once. Their size follows the
   input's up to `MAX_CELLS` (2 rows, 64 MB each at the bound), then stays: beyond it more
   windows pass to step 2, and the result is the same.
2. Only windows whose anchor is "many" in both rows go on. The sketch never counts too low, so
   no repeated window is lost; those let through by chance fall out here: windows are
   grouped exactly by a 96-bit hash, and each takes the smallest doc_id. The windows are
   written once, and those that repeat are cut off before they are joined back, so adaptive
   execution can split the join where one window has a large share of all rows.
   Exact copies of a whole text are set apart before both steps: all their windows are
   repeated, so only the copy with the smallest doc_id is worth counting.
3. Words covered by a window that starts in a document with a smaller doc_id are removed.

Windows are judged on the input. Null texts are empty; rows that share a doc_id don't remove
from each other, and rows with a null doc_id neither remove nor lose anything. Texts of any
length are worked on whole, in blocks of words. An empty table gives no rows; columns that
aren't kept can't clash, and kept ones may have any name but those of the result.
"""

from __future__ import annotations

import glob
import hashlib
import uuid
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, maybe_in, of, shared_dir, spread, written
from ._text import BLOCK, chunks, grams, hashes, mix, utf8, words

MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 29
SHARDS, FAN, FLUSH, FILES = 64, 8, 1 << 21, 8
_ROWS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15))
_PART = "side int, shard int, salt int, ones binary, many binary"


def _anchors(h: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word position of each window that lies in one document, and its anchor."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    k = (window + 1) // 2
    g = grams(h, k)
    least = g[:n].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, g[j : j + n], out=least)
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return at, least[at]


def _cells(anchors: np.ndarray, side: int, cells: int) -> np.ndarray:
    return (mix(anchors ^ _ROWS[side]) & np.uint64(cells - 1)).astype(np.int64)


def _zip(x: np.ndarray) -> bytes:
    return zlib.compress(np.diff(x, prepend=0).astype("<u4").tobytes(), 1)


def _unzip(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), "<u4"), dtype=np.int64)


def _sketched(window: int, cells: int):
    """Each task's sketch as rows of _PART: cells of a shard seen once, and more often."""
    wide = cells // SHARDS

    def rows(found: list[np.ndarray]):
        salt = TaskContext.get().partitionId() % FAN
        anchors = np.concatenate(found)
        for side in (0, 1):
            at, n = np.unique(_cells(anchors, side, cells), return_counts=True)
            cuts = np.searchsorted(at, np.arange(SHARDS + 1) * wide)
            for shard in range(SHARDS):
                x, many = at[cuts[shard] : cuts[shard + 1]] - shard * wide, n[cuts[shard] : cuts[shard + 1]] > 1
                if len(x):
                    yield side, shard, salt, _zip(x[~many]), _zip(x[many])

    def run(batches):
        found, held = [], 0
        for b in batches:
            for _, data, offsets in chunks(*utf8(b.column(0))):
                starts, ends, doc = words(data, offsets)
                at, anchors = _anchors(hashes(data, starts, ends), doc, window)
                if not len(at):
                    continue
                new = np.ones(len(at), bool)  # runs of one anchor count once; then once for each document
                new[1:] = (anchors[1:] != anchors[:-1]) | (doc[at[1:]] != doc[at[:-1]])
                a, d = anchors[new], doc[at[new]]
                order = np.lexsort((a, d))
                a, d = a[order], d[order]
                new = np.ones(len(a), bool)
                new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
                found.append(a[new])
                held += int(new.sum())
                if held > FLUSH:
                    yield _part_batch(rows(found))
                    found, held = [], 0
        if held:
            yield _part_batch(rows(found))

    return run


def _part_batch(rows) -> pa.RecordBatch:
    x = list(zip(*rows))
    kinds = [pa.int32()] * 3 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(x, kinds)], ["side", "shard", "salt", "ones", "many"])


def _merged(wide: int, dense: bool):
    """Adds up rows of _PART sorted by shard; a task holds one shard's planes at a time."""
    bits = lambda x: np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool)

    def flush(key, one, many):
        packed = [zlib.compress(np.packbits(p).tobytes(), 1) for p in (one, many)]
        return _part_batch([(*key, 0, *packed)])

    def run(batches):
        last, one, many = None, None, None
        for b in batches:
            for side, shard, _, x, y in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (side, shard) != last:
                    if last is not None:
                        yield flush(last, one, many)
                    last, one, many = (side, shard), np.zeros(wide, bool), np.zeros(wide, bool)
                if dense:
                    new, more = bits(x), bits(y)
                    many |= more | (one & new)
                    one |= new
                else:
                    at, more = _unzip(x), _unzip(y)
                    many[at[one[at]]] = True
                    many[more] = True
                    one[at] = True
                    one[more] = True
        if last is not None:
            yield flush(last, one, many)

    return run


def repeated_cells(docs: DataFrame, window: int) -> tuple[str, int]:
    """(name of the files with the two rows' "many" bits, cells of a row)."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = MIN_CELLS
    while 4 * cells < size and cells < MAX_CELLS:  # about one anchor in 25 bytes: a load of a fifth at most
        cells *= 2
    wide = cells // SHARDS
    parts = docs.select("text").mapInArrow(_sketched(window, cells), _PART)
    parts = parts.repartition("side", "shard", "salt").sortWithinPartitions("side", "shard").mapInArrow(_merged(wide, False), _PART)
    parts = parts.repartition("side", "shard").sortWithinPartitions("side", "shard").mapInArrow(_merged(wide, True), _PART)
    name = f"many-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/sketches/{name}"
    parts.select("side", "shard", "many").repartition(FILES, "shard").write.option("compression", "none").parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()  # FILES names at most
    for i, f in enumerate(files):
        spark.sparkContext.addFile(_as(spark, f.path, f"{path}/{name}-{i}"))
    return name, cells


def _as(spark, path: str, to: str) -> str:
    """Renames a file in the shared folder: executors keep files by their last name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(to)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(jvm.org.apache.hadoop.fs.Path(path), at)
    return to


_loaded: dict[str, np.ndarray] = {}


def _planes(name: str, cells: int) -> np.ndarray:
    """In a task: the "many" bits, unpacked once by each Python worker."""
    if name not in _loaded:
        _loaded.clear()
        planes, wide = np.zeros((2, cells // 8), np.uint8), cells // SHARDS // 8
        for path in glob.glob(f"{glob.escape(SparkFiles.getRootDirectory())}/{name}-*"):
            with pq.ParquetFile(path) as f:
                for b in f.iter_batches(1):
                    for side, shard, many in zip(*(b.column(i).to_pylist() for i in range(3))):
                        planes[side, shard * wide : (shard + 1) * wide] = np.frombuffer(zlib.decompress(many), np.uint8)
        _loaded[name] = planes
    return _loaded[name]


def _windows(window: int, many, cells: int):
    """(h1, h2, doc_id, tie, pos) of windows that the sketch takes for repeated."""

    def run(batches):
        planes = _planes(many, cells)
        for b in batches:
            ids, ties = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in chunks(*utf8(b.column(2)), BLOCK):
                starts, ends, doc = words(data, offsets)
                h = hashes(data, starts, ends)
                at, anchors = _anchors(h, doc, window)
                for side in (0, 1):
                    c = _cells(anchors, side, cells)
                    on = planes[side][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1 == 1
                    at, anchors = at[on], anchors[on]
                if not len(at):
                    continue
                h1 = grams(h, window)[at]
                h2 = grams(hashes(data, starts, ends, seed=1), window)[at]
                row = doc[at]
                pos = at - np.searchsorted(doc, row)
                yield pa.RecordBatch.from_arrays([pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(ids[first + row]), pa.array(ties[first + row]), pa.array(pos.astype(np.int32))], ["h1", "h2", "doc_id", "tie", "pos"])

    return run


def repeated_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tie, pos) of each window that also starts in a document with a smaller doc_id.

    docs: doc_id, tie (a 32-bit hash of the text), text.
    """
    many, cells = repeated_cells(docs, window)
    rows = written(docs.mapInArrow(_windows(window, many, cells), "h1 long, h2 int, doc_id long, tie int, pos int"))
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    first = cut(first)
    return rows.join(first, ["h1", "h2"]).where("doc_id > first").select("doc_id", "tie", "pos")


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, tie) of documents whose whole text a smaller doc_id has too."""
    d = docs.select("doc_id", "tie", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    first = cut(d.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"))
    return cut(d.join(first, ["t1", "t2"]).where("doc_id > first").select("doc_id", "tie").distinct())


def _removed(window: int, digest: bool, layout: bool):
    def run(batches):
        for b in batches:
            texts, gone, copied = (b.column(b.num_columns - i) for i in (3, 2, 1))
            whole = copied.to_pylist()
            total, removed, kept = [], [], []
            for i in range(len(texts)):
                raw = texts[i].as_buffer().to_pybytes() if texts[i].is_valid else b""
                parts = raw.split()  # at 0x20 and 0x09-0x0D
                n, out = len(parts), None
                if whole[i] and n >= window:
                    out = b""
                    removed.append(n)
                elif gone[i].is_valid and len(gone[i]):
                    p = gone[i].values.to_numpy(zero_copy_only=False)
                    steps = np.zeros(n + 1, np.int64)
                    steps[np.unique(p)] += 1
                    steps[np.unique(p) + window] -= 1
                    stay = np.cumsum(steps[:n]) == 0
                    out = _laid_out(raw, stay) if layout else b" ".join(compress(parts, stay.tolist()))
                    removed.append(int(n - stay.sum()))
                else:
                    out = raw if layout else b" ".join(parts)
                    removed.append(0)
                total.append(n)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            names = [*b.schema.names[:-3], "n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names)

    return run


def _laid_out(raw: bytes, stay: np.ndarray) -> bytes:
    """raw without the words that go and the white space after each."""
    starts, _, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    bounds = np.append(starts, len(raw))
    lead, out, i = raw[: bounds[0]], [], 0
    edges = np.flatnonzero(np.diff(stay.astype(np.int8), prepend=0, append=0))
    for a, z in zip(edges[::2], edges[1::2]):
        out.append(raw[bounds[a] : bounds[z]])
    return lead + b"".join(out)


def dedup_substrings(docs: DataFrame, window: int = 50, digest: bool = False, layout: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_words, n_removed, kept_text) for each row of docs.

    kept_text keeps the white space between kept words, or one space with layout=False;
    with digest its SHA-256 stands instead, as kept_sha256. keep: further text columns.
    """
    d = of(docs, doc_id="long", text="string", **{c: "string" for c in keep})
    d = spread(d).withColumn("tie", F.hash("text"))
    known = d.where("doc_id is not null").select("doc_id", "tie", "text")
    copies = _copies(known)
    marked = maybe_in(known, "doc_id", copies.select("doc_id"))
    counted = marked.where("not maybe").unionByName(marked.where("maybe").join(copies, ["doc_id", "tie"], "left_anti")).drop("maybe")
    gone = repeated_windows(counted, window).groupBy("doc_id", "tie").agg(F.collect_set("pos").alias("gone"))
    gone = cut(gone.withColumn("copied", F.lit(False)).unionByName(copies.select("doc_id", "tie", F.lit(None).cast("array<int>").alias("gone"), F.lit(True).alias("copied"))))
    marked = maybe_in(d, "doc_id", gone.select("doc_id"))
    same = marked.where("not maybe").select("doc_id", *keep, "text", F.lit(None).cast("array<int>").alias("gone"), F.lit(False).alias("copied"))
    out = marked.where("maybe").join(gone, ["doc_id", "tie"], "left").select("doc_id", *keep, "text", "gone", F.coalesce("copied", F.lit(False)).alias("copied"))
    out = same.unionByName(out)
    schema = ", ".join(["doc_id long", *(f"`{c}` string" for c in keep), "n_words long", "n_removed long", "kept_sha256 string" if digest else "kept_text string"])
    return out.mapInArrow(_removed(window, digest, layout), schema)
