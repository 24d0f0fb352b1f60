"""What the operators share: the manifest's columns and small helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

KEYS = ["folder_id", "path"]
MANIFEST = {
    "version": "map<string,bigint>",
    "size": "bigint",
    "deleted": "boolean",
    "blocks": "array<string>",
    "cdh": "array<string>",
    "clens": "array<bigint>",
    "mtime": "bigint",
    "placeholder": "boolean",
}


def as_manifest(df: DataFrame, *more: str) -> DataFrame:
    """df with the manifest's columns, missing ones as null (false for flags), and `more`; others dropped."""
    have = set(df.columns)
    cols = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in MANIFEST.items()]
    return df.select(*KEYS, *cols, *more).fillna(False, ["deleted", "placeholder"])


def side(df: DataFrame, name: str) -> DataFrame:
    """(folder_id, path, <name>): a manifest's rows as structs."""
    return as_manifest(df).select(*KEYS, F.struct(*MANIFEST).alias(name))


def ancestors(path: Column | str) -> Column:
    """The directories above a path, from the root down, without the path itself."""
    parts = F.split(F.col(path) if isinstance(path, str) else path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def truncated(df: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first `limit` rows of each folder_id with a column `truncated`: whether it had more.

    Ranks up to limit + 1 are found in each task before the shuffle, so a folder of any size
    sends so many rows from a task at most.
    """
    w = Window.partitionBy("folder_id")
    top = df.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= limit + 1)
    return top.withColumn("truncated", F.max("_n").over(w) > limit).where(F.col("_n") <= limit).drop("_n")


def parsed_lists(parse: Callable[[str], Iterator[tuple]], *names: str) -> Callable[[Column], Column]:
    """A column function from texts to arrays of structs of strings: what parse() yields for each, as flat Arrow arrays."""
    kind = "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"

    @arrow_udf(kind)
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            flat, ends = [], [0]
            for text in texts.to_pylist():
                flat += parse(text or "")
                ends.append(len(flat))
            fields = [pa.array(v, pa.string()) for v in (zip(*flat) if flat else [()] * len(names))]
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names))

    return run
