"""Commit tables: paging, unpushed commits, change counts and work-tree agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import KEYS, as_manifest, parsed_lists, truncated
from tidemark.session import ship_package


def commit_page(commits: DataFrame, limit: int = 20, skip: int = 0, most: int = 100) -> DataFrame:
    """A page of (.., date, hash) rows, newest first."""
    return commits.orderBy(F.desc("date"), "hash").offset(max(0, skip)).limit(min(max(1, limit), most))


def unpushed_commits(commits: DataFrame, upstream: DataFrame, newest: int = 50) -> DataFrame:
    """Commits (folder_id, hash, date, ..) not in upstream (folder_id, hash): the newest of each
    folder, with total and truncated. Folders without any give no row."""
    left = commits.join(upstream.select("folder_id", "hash"), ["folder_id", "hash"], "left_anti")
    total = left.groupBy("folder_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("folder_id").orderBy(F.desc("date"), "hash")
    top = left.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= newest).drop("_n")
    return top.join(total, "folder_id").withColumn("truncated", F.col("total") > newest)


def change_status(xy: Column | str, renamed: Column | str) -> Column:
    """deleted, renamed, added or modified from the two status letters; deletion counts first."""
    x = F.col(xy) if isinstance(xy, str) else xy
    r = F.col(renamed) if isinstance(renamed, str) else renamed
    return F.when(F.instr(x, "D") > 0, "deleted").when(r, "renamed").when((F.instr(x, "A") > 0) | (x == "??"), "added").otherwise("modified")


def _records(output: str):
    """Records and the old paths of renames."""
    parts = (s for s in output.split("\0") if s)
    for rec in parts:
        yield rec, next(parts, None) if "R" in rec[:2] or "C" in rec[:2] else None


def git_entries(exported: DataFrame) -> DataFrame:
    """All entries (*columns but output, pos, path, status, orig_path, staged, dir) of rows (.., output),
    each row parsed for itself; an output is the NUL-separated porcelain status of one export."""
    ship_package(exported.sparkSession)
    records = parsed_lists(_records, "rec", "orig")
    rest = [c for c in exported.columns if c != "output"]
    rows = exported.select(*rest, F.posexplode(records("output")).alias("pos", "e"))
    xy, raw = F.substring("e.rec", 1, 2), F.substring("e.rec", 4, 1 << 30)
    return rows.where(raw != "").select(
        *rest,
        "pos",
        F.regexp_replace(raw, "/$", "").alias("path"),
        change_status(xy, F.col("e.orig").isNotNull()).alias("status"),
        F.col("e.orig").alias("orig_path"),
        (~F.substring(xy, 1, 1).isin(" ", "?")).alias("staged"),
        raw.endswith("/").alias("dir"),
    )


def git_changes(exported: DataFrame, most: int = 2000) -> DataFrame:
    """(folder_id, path, status, orig_path, staged, dir, truncated) from (folder_id, output): the
    NUL-separated porcelain status of each folder; the first `most` entries of a folder."""
    out = git_entries(exported.select("folder_id", "output"))
    return truncated(out, most, "pos").drop("pos")


def git_change_counts(changes: DataFrame) -> DataFrame:
    kinds = ("deleted", "renamed", "added", "modified")
    return changes.groupBy("folder_id").agg(*[F.count_if(F.col("status") == k).alias(k) for k in kinds], F.count_if("staged").alias("staged"))


def worktree_aligned(changed: DataFrame, manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(*keys, aligned): whether each commit's files stand on disk as the manifest says.

    changed: (folder_id, path) of one commit a folder, or of many with further columns that tell
    them apart; all columns but path are the keys. disk: (folder_id, path, size, blocks). No entry: not aligned; a tombstone must be absent;
    else size, then block hashes must agree.
    """
    m = as_manifest(manifest).select(*KEYS, F.struct("deleted", "size", "blocks").alias("m"))
    d = disk.select(*KEYS, F.struct("size", "blocks").alias("d"))
    keys = [c for c in changed.columns if c != "path"]
    j = changed.distinct().join(m, KEYS, "left").join(d, KEYS, "left")
    ok = (
        F.when(F.col("m").isNull(), False)
        .when(F.col("m.deleted"), F.col("d").isNull())
        .when(F.col("d").isNull() | (F.col("m.size") != F.col("d.size")), False)
        .otherwise(F.col("m.blocks") == F.col("d.blocks"))
    )
    return j.groupBy(*keys).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("aligned"))
