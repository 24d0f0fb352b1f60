"""Audits: do equal versions mean equal content, and does the disk hold what the index says?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.functions.scalars import chunk_view, pick_slot
from tidemark.functions.vectors import compare_versions
from tidemark.operators.common import KEYS, as_manifest, side
from tidemark.session import ship_package


def equal_pairs(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(folder_id, path, local, remote) of live rows whose vectors are equal."""
    live = lambda df: as_manifest(df).where("not deleted")
    j = side(live(local), "local").join(side(live(remote), "remote"), KEYS)
    return j.where(compare_versions("local.version", "remote.version") == "equal")


def _first_difference(a: Column, b: Column) -> Column:
    """Index of the first unequal element of two lists of one length; null if none."""
    return F.get(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0))), lambda i: (F.size(a) > 0) & (F.get(a, i) != F.get(b, i))), 0)


def declared_drift(pairs: DataFrame) -> DataFrame:
    """(folder_id, path, kind, slot, of_local, of_remote) of pairs that declare different content.

    kind: size, slots (how many, or of which lengths) or content, with the first slot that
    differs (else null); the last two are what either side declares of it, as text: bytes,
    numbers of slots, hashes. Compared by chunks if both sides have that view, else by blocks.
    """
    l, r = F.col("local"), F.col("remote")
    chunked = chunk_view(l["cdh"], l["clens"]) & chunk_view(r["cdh"], r["clens"])
    a, b = F.when(chunked, l["cdh"]).otherwise(l["blocks"]), F.when(chunked, r["cdh"]).otherwise(r["blocks"])
    layout = F.when(chunked, l["clens"] != r["clens"]).otherwise(F.size(a) != F.size(b))
    at = _first_difference(a, b)
    kind = F.when(l["size"] != r["size"], "size").when(layout, "slots").when(at.isNotNull(), "content")
    said = lambda x, list_: F.when(kind == "size", x["size"].cast("string")).when(kind == "slots", F.size(list_).cast("string")).otherwise(F.get(list_, at))
    return pairs.select(*KEYS, kind.alias("kind"), F.when(kind == "content", at).alias("slot"), said(l, a).alias("of_local"), said(r, b).alias("of_remote")).where("kind is not null")


def stride_sample(rows: DataFrame, n: int, round_: int) -> DataFrame:
    """Every ceil(rows / n)-th row of a folder, starting at round % step: n at most, other
    ones each round.

    The order is (first two hex digits of the path's MD5, path): repeatable, and a folder of
    any size is numbered in 256 independent parts whose counts are summed first.
    """
    if n <= 0:
        return rows.limit(0)
    r = rows.withColumn("_b", F.substring(F.md5("path"), 1, 2))
    counts = r.groupBy("folder_id", "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy("folder_id")  # over 256 rows of counts at most
    counts = counts.select("folder_id", "_b", (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_rows"))
    numbered = r.withColumn("_n", F.row_number().over(Window.partitionBy("folder_id", "_b").orderBy("path")) - 1)
    step = F.greatest(F.lit(1), F.ceil(F.col("_rows") / n))
    out = numbered.join(counts, ["folder_id", "_b"]).where((F.col("_before") + F.col("_n")) % step == F.lit(round_) % step)
    return out.drop("_b", "_n", "_before", "_rows")


@arrow_udf(T.ArrayType(T.LongType()))
def _starts(lens: pa.Array) -> pa.Array:
    """The sum of the values before each one, list by list."""
    lens = lens.cast(pa.list_(pa.int64()))
    flat = lens.flatten().fill_null(0).to_numpy(zero_copy_only=False)
    size = lens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    before = np.concatenate([[0], np.cumsum(flat)])
    first = ends - size
    values = before[:-1] - np.repeat(before[first], size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, pa.int64()))


def slot_layout(files: DataFrame, lengths: str = "lens") -> DataFrame:
    """(folder_id, path, slot, offset, length) from a list column of slot lengths.

    The prefix sum runs inside each file's row, so no shuffle is needed.
    """
    ship_package(files.sparkSession)
    some = files.where(F.size(lengths) > 0).select(*KEYS, F.col(lengths).cast("array<bigint>").alias("l")).withColumn("o", _starts("l"))
    return some.select(*KEYS, F.posexplode(F.arrays_zip("o", "l")).alias("slot", "s")).select(*KEYS, "slot", F.col("s.o").alias("offset"), F.col("s.l").alias("length"))


def fixed_layout(files: DataFrame, block: int, size: str = "size") -> DataFrame:
    """(folder_id, path, slot, offset, length) of fixed blocks; the last one is shorter."""
    n = F.ceil(F.col(size) / block)
    rows = files.where(F.col(size) > 0).select(*KEYS, size, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("slot"))
    offset = F.col("slot").cast("bigint") * block
    return rows.select(*KEYS, "slot", offset.alias("offset"), F.least(F.lit(block).cast("bigint"), F.col(size) - offset).alias("length"))


def local_samples(manifest: DataFrame, n: int, round_: int) -> DataFrame:
    """(folder_id, path, slot, declared, chunked, ...) of a round's slots to verify on disk.

    Tombstones, placeholders and empty files are no candidates; chunks come before blocks.
    """
    m = as_manifest(manifest).where("not deleted and not placeholder")
    chunked = chunk_view("cdh", "clens")
    m = m.withColumn("chunked", chunked).withColumn("hashes", F.when(chunked, F.col("cdh")).otherwise(F.col("blocks"))).where(F.size("hashes") > 0)
    s = stride_sample(m, n, round_)
    slot = pick_slot(F.concat("path", F.lit(f":{round_}")), F.size("hashes"))
    return s.withColumn("slot", slot.cast("int")).withColumn("declared", F.get("hashes", F.col("slot")))


def slot_verify(samples: DataFrame, content: DataFrame, block: int) -> DataFrame:
    """samples with verdict: ok, drift or unreadable. content: (folder_id, path, content)."""
    before = F.aggregate(F.slice("clens", F.lit(1), F.col("slot")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    offset = F.when(F.col("chunked"), before).otherwise(F.col("slot").cast("bigint") * block)
    length = F.when(F.col("chunked"), F.get("clens", F.col("slot"))).otherwise(F.lit(block).cast("bigint"))
    j = samples.join(content.select(*KEYS, "content"), KEYS, "left").withColumn("_o", offset).withColumn("_l", length)
    actual = F.sha2(F.expr("substring(content, cast(_o + 1 as int), cast(_l as int))"), 256)
    short = F.col("content").isNull() | F.col("declared").isNull() | (F.length("content") <= F.col("_o"))
    verdict = F.when(short, "unreadable").when(actual == F.col("declared"), "ok").otherwise("drift")
    return j.select(*KEYS, "slot", verdict.alias("verdict"))


def audit_summary(candidates: DataFrame, sampled: DataFrame, declared: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """(folder_id, candidates, sampled, declared, disk, unreadable) of a round."""
    parts = [candidates.select("folder_id", F.lit("candidates").alias("k")), sampled.select("folder_id", F.lit("sampled").alias("k"))]
    parts += [declared.select("folder_id", F.lit("declared").alias("k"))] if declared is not None else []
    if verdicts is not None:
        parts.append(verdicts.where("verdict <> 'ok'").select("folder_id", F.when(F.col("verdict") == "drift", "disk").otherwise("unreadable").alias("k")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("folder_id").agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("candidates", "sampled", "declared", "disk", "unreadable")])
