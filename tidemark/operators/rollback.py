"""Point-in-time rollback, archives and retention.

versions: (folder_id, path, file, ts); trash: the same; events: (folder_id, path, ts, action);
current: (folder_id, path, mtime). Times are bigint milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.common import KEYS


def first_event(events: DataFrame) -> DataFrame:
    """(folder_id, path, action, ts): the earliest event of each path."""
    return events.groupBy(*KEYS).agg(F.min_by("action", "ts").alias("action"), F.min("ts").alias("ts"))


def nearest_versions(versions: DataFrame, target: int) -> DataFrame:
    """(folder_id, path, after, before): the earliest version after T and the latest up to T, as (file, ts)."""
    pick = F.struct("file", "ts")
    late = F.col("ts") > target
    return versions.groupBy(*KEYS).agg(F.min_by(F.when(late, pick), F.when(late, F.col("ts"))).alias("after"), F.max_by(F.when(~late, pick), F.when(~late, F.col("ts"))).alias("before"))


def rollback_plan(versions: DataFrame, trash: DataFrame, events: DataFrame, current: DataFrame, target: int) -> DataFrame:
    """(folder_id, path, outcome, file, ts) that bring a folder back to time T.

    outcome: restore, trash-current, from-trash, no-snapshot, lost-delete. A path absent now
    comes back if any version of it exists, even one whose file was deleted before T; a path
    whose first event is an add after T goes only if it has no version at all; a present path
    is replaced if it changed since T or a later version shows that it was overwritten.
    """
    late = F.col("ts") > target
    v = nearest_versions(versions, target)
    t = trash.groupBy(*KEYS).agg(F.coalesce(F.min_by(F.when(late, F.col("file")), F.when(late, F.col("ts"))), F.max_by("file", "ts")).alias("trash_file"))
    e = events.groupBy(*KEYS).agg(F.min_by("action", "ts").alias("first_action"), F.min("ts").alias("first_ts"), F.bool_or((F.col("action") == "delete") & late).alias("deleted_later"))
    c = current.select(*KEYS, F.col("mtime").alias("now"))
    j = v.join(t, KEYS, "full_outer").join(e, KEYS, "full_outer").join(c, KEYS, "full_outer")
    best = F.coalesce("after", "before")
    added = F.coalesce((F.col("first_action") == "add") & (F.col("first_ts") > target), F.lit(False)) & best.isNull()
    changed = F.coalesce(F.col("now") > target, F.lit(False))
    deleted = F.coalesce("deleted_later", F.lit(False))
    outcome = (
        F.when(F.col("now").isNotNull() & added, "trash-current")
        .when(F.col("now").isNotNull() & best.isNotNull() & (changed | F.col("after").isNotNull()), "restore")
        .when(F.col("now").isNotNull() & changed & best.isNull() & F.col("first_ts").isNotNull(), "no-snapshot")
        .when(F.col("now").isNotNull(), F.lit(None))
        .when(best.isNotNull(), "restore")
        .when(deleted & F.col("trash_file").isNotNull(), "from-trash")
        .when(deleted, "lost-delete")
    )
    out = j.withColumn("outcome", outcome).where("outcome is not null")
    file = F.when(F.col("outcome") == "restore", best["file"]).when(F.col("outcome") == "from-trash", F.col("trash_file"))
    return out.select(*KEYS, "outcome", file.alias("file"), F.when(F.col("outcome") == "restore", best["ts"]).alias("ts"))


def rollback_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("folder_id", "outcome").agg(F.count("*").alias("n"))


def version_retention(versions: DataFrame, keep: int = 10) -> DataFrame:
    """Archived versions beyond the newest `keep` of each path, by file name: the ones to prune."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("file"))
    return versions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def version_groups(versions: DataFrame) -> DataFrame:
    """(folder_id, path, n, latest, files): versions by path, newest first; latest groups first."""
    newest = F.sort_array(F.collect_list(F.struct("ts", "file")), False)
    each = versions.groupBy(*KEYS).agg(F.count("*").alias("n"), F.max("ts").alias("latest"), F.transform(newest, lambda s: s["file"]).alias("files"))
    return each.orderBy(F.desc("latest"), *KEYS)
