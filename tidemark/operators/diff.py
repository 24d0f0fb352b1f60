"""Comparing two sides of a folder, without changing either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ignore import Rule, hard_ignored, matching_rule
from tidemark.functions.scalars import content_digest
from tidemark.functions.vectors import compare_file_state
from tidemark.operators.common import KEYS, ancestors, as_manifest

#: Kinds by falling severity.
KINDS = ("content-mismatch", "conflict", "local-newer", "remote-newer", "ignored-locally", "ignored-remotely", "in-sync")


def to_snapshot(manifest: DataFrame) -> DataFrame:
    """Comparison rows: block lists folded to one digest."""
    m = as_manifest(manifest)
    return m.select(*KEYS, "version", "size", "deleted", content_digest("blocks").alias("digest"), "mtime")


def folder_diff(local: DataFrame, remote: DataFrame, local_rules: list[Rule] = (), remote_rules: list[Rule] | None = None) -> DataFrame:
    """(folder_id, path, kind, severity, local, remote, rule, hard) of two snapshots.

    Rows of kind in-sync are kept for counting; diff_items() leaves them out. A tombstone that
    one side alone knows is in sync; equal versions with different content are a mismatch.
    """
    pack = lambda df, name: df.select(*KEYS, F.struct("version", "size", "deleted", "digest", "mtime").alias(name))
    j = pack(local, "local").join(pack(remote, "remote"), KEYS, "full_outer")
    l, r = F.col("local"), F.col("remote")
    here, there = l.isNotNull(), r.isNotNull()
    state = compare_file_state(here, there, l["version"], r["version"])
    same = (l["deleted"] == r["deleted"]) & (l["deleted"] | ((l["size"] == r["size"]) & (l["digest"] == r["digest"])))
    mine = matching_rule(list(local_rules), "path")
    theirs = F.lit(None).cast("string") if remote_rules is None else matching_rule(list(remote_rules), "path")
    kind = (
        F.when(~here & there, F.when(r["deleted"], "in-sync").when(mine.isNotNull(), "ignored-locally").otherwise("remote-newer"))
        .when(here & ~there, F.when(l["deleted"], "in-sync").when(theirs.isNotNull(), "ignored-remotely").otherwise("local-newer"))
        .when(state == "equal", F.when(same, "in-sync").otherwise("content-mismatch"))
        .otherwise(state)
    )
    rule = F.when(F.col("kind") == "ignored-locally", mine).when(F.col("kind") == "ignored-remotely", theirs)
    severity = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    out = j.withColumn("kind", kind)
    return out.select(*KEYS, "kind", severity.alias("severity"), "local", "remote", rule.alias("rule"), (rule.isNotNull() & hard_ignored("path")).alias("hard"))


def diff_items(diff: DataFrame) -> DataFrame:
    """The differences, most severe first, then by path (binary order)."""
    return diff.where("kind <> 'in-sync'").orderBy("severity", "path")


def diff_counts(diff: DataFrame) -> DataFrame:
    """One row a folder: a column for each kind, and total without in-sync."""
    names = [k.replace("-", "_") for k in KINDS]
    each = [F.count_if(F.col("kind") == k).alias(n) for k, n in zip(KINDS, names)]
    return diff.groupBy("folder_id").agg(*each).withColumn("total", sum((F.col(n) for n in names[:-1]), F.lit(0)).cast("bigint"))


def disk_check(diff: DataFrame, listing: DataFrame) -> DataFrame:
    """diff with `disk`: ok, missing or size-differs for live local rows. listing: (folder_id, path, size)."""
    on_disk = listing.select(*KEYS, F.col("size").alias("_disk"))
    asked = F.col("local").isNotNull() & ~F.col("local.deleted")
    state = F.when(asked, F.when(F.col("_disk").isNull(), "missing").when(F.col("_disk") == F.col("local.size"), "ok").otherwise("size-differs"))
    return diff.join(on_disk, KEYS, "left").withColumn("disk", state).drop("_disk")


def compare_tree(local: DataFrame, remote: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(folder_id, path, is_dir, status) of snapshots: files and the directories above them.

    status: same, diff, only-local, only-remote; a directory's is diff if anything below it
    isn't same. Files deleted on every side they have, and directories of such, are left out.
    kinds: (folder_id, path, kind) of a diff, whose verdict comes before size and digest.
    """
    pack = lambda df, name: df.select(*KEYS, F.struct("size", "deleted", "digest").alias(name))
    j = pack(local, "l").join(pack(remote, "r"), KEYS, "full_outer")
    j = j.withColumn("kind", F.lit(None).cast("string")) if kinds is None else j.join(kinds.select(*KEYS, "kind"), KEYS, "left")
    l, r = F.col("l"), F.col("r")
    live = F.coalesce(~l["deleted"], F.lit(False)) | F.coalesce(~r["deleted"], F.lit(False))
    clean: Column = F.array_join(F.filter(F.split("path", "/"), lambda s: s != ""), "/")
    status = (
        F.when(r.isNull(), "only-local")
        .when(l.isNull(), "only-remote")
        .when(l["deleted"] != r["deleted"], "diff")
        .when(F.coalesce(F.col("kind") != "in-sync", F.lit(False)), "diff")
        .otherwise(F.when((l["size"] == r["size"]) & (l["digest"] == r["digest"]), "same").otherwise("diff"))
    )
    files = j.where(live).select("folder_id", clean.alias("path"), status.alias("status")).where("path <> ''")
    above = files.select("folder_id", F.explode(ancestors("path")).alias("path"), (F.col("status") != "same").alias("changed"))
    dirs = above.groupBy(*KEYS).agg(F.bool_or("changed").alias("changed"))
    return files.select(*KEYS, F.lit(False).alias("is_dir"), "status").unionByName(dirs.select(*KEYS, F.lit(True).alias("is_dir"), F.when(F.col("changed"), "diff").otherwise("same").alias("status")))


def tree_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("folder_id", "status").agg(F.count("*").alias("n"))


def manifest_fingerprint(manifest: DataFrame) -> DataFrame:
    """(folder_id, fingerprint): equal exactly if the live content of two manifests is.

    A hash of each row (vector sorted; time and placeholders left out), then per folder the
    64-bit-lane sums of row hashes and the count: it merges by partial aggregation, in any
    order and without gathering a folder's rows anywhere. Two hashes of a row give four lanes.
    """
    from tidemark.functions.vectors import canonical

    m = as_manifest(manifest).where("not placeholder")
    vector = F.array_join(F.transform(canonical("version"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    lens = F.array_join(F.transform("clens", lambda n: n.cast("string")), ",")
    row = F.sha2(F.concat_ws("\0", "path", vector, F.col("size").cast("string"), F.col("deleted").cast("string"), F.array_join("blocks", ","), F.coalesce(F.array_join("cdh", ","), F.lit("")), F.coalesce(lens, F.lit(""))), 256)
    lane = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return m.groupBy("folder_id").agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[lane(i) for i in range(4)]), 256).alias("fingerprint"))


def changed_folders(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Folders whose fingerprints differ, or that one side lacks: the only ones worth comparing."""
    a, b = manifest_fingerprint(local).withColumnRenamed("fingerprint", "a"), manifest_fingerprint(remote).withColumnRenamed("fingerprint", "b")
    return a.join(b, "folder_id", "full_outer").where("not a <=> b").select("folder_id")
