"""Small Spark helpers of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship_package

BATCH_BYTES = 8 << 20  # of a batch sent to a Python worker
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def written(df: DataFrame) -> DataFrame:
    """df as Parquet under the shared checkpoint folder, read again: for wide rows, since Parquet is compressed."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def of(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Other columns can't clash.

    Operators begin here, so this is also where executors get the package. Long texts make large batches, so the session's bound of a batch in bytes, if nobody has set one, is lowered.
    """
    ship_package(df.sparkSession)
    conf = df.sparkSession.conf
    if conf.get(_BATCH) == "67108864b":  # Spark's default
        conf.set(_BATCH, str(BATCH_BYTES))
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


SMALL = 4 << 20  # bytes for each core: what is less is dealt out, since one small file would be one task


def spread(df: DataFrame) -> DataFrame:
    """df, dealt to all cores if the optimizer takes it for small; for work that Python does on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fields(**kinds: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{c}` {k}" for c, k in kinds.items()))


WORDS = 1 << 20  # 64-bit words of a membership filter: at most so many rows are broadcast


def maybe_in(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df with a column `maybe`: false only if df[key] is surely not in ids (one bigint column).

    A bitmap of 64 * WORDS hashed cells, made by aggregation and broadcast: its size is
    bounded whatever the data's. An exact join follows; this keeps rows out of its shuffle.
    """
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS))
    (name,) = ids.columns
    words = ids.select(F.shiftright(cell(name), 6).cast("int").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(`{name}`), {64 * WORDS}L) & 63 AS int))").alias("_bit"))
    words = words.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    out = df.withColumn("_word", F.shiftright(cell(key), 6).cast("int")).join(F.broadcast(words), "_word", "left")
    on = F.expr(f"shiftrightunsigned(_bits, cast(pmod(xxhash64(`{key}`), {64 * WORDS}L) & 63 AS int)) & 1L") == 1
    return out.withColumn("maybe", F.coalesce(on, F.lit(False))).drop("_word", "_bits")
