"""Listings against manifests: what changed on disk, what is gone, what may be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ignore import CONFLICT_COPY, Rule, ignored_path
from tidemark.functions.vectors import increment_version
from tidemark.operators.common import KEYS, ancestors, as_manifest, truncated


def under_prefix(rows: DataFrame, dirs: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is one of dirs (folder_id, dir) or below one: an equi-join on ancestors."""
    d = dirs.select("folder_id", F.col("dir").alias("_dir")).distinct()
    keyed = rows.select(*KEYS).distinct().withColumn("_dir", F.explode(F.concat(ancestors(path), F.array(path))))
    return rows.join(keyed.join(d, ["folder_id", "_dir"], "left_semi").select(*KEYS).distinct(), KEYS, "left_semi")


def outside_nested_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows that belong to no other folder nested inside. roots: (folder_id, dir)."""
    d = roots.select("folder_id", F.col("dir").alias("_dir")).distinct()
    keyed = rows.select(*KEYS).distinct().withColumn("_dir", F.explode(F.concat(ancestors("path"), F.array("path"))))
    return rows.join(keyed.join(d, ["folder_id", "_dir"], "left_semi").select(*KEYS).distinct(), KEYS, "left_anti")


def unchanged(entry_size: Column, entry_mtime: Column, size: Column, mtime: Column) -> Column:
    """Same size and exactly the same time; a missing time counts as changed."""
    return F.coalesce((entry_size == size) & (entry_mtime == mtime), F.lit(False))


def placeholders(manifest: DataFrame) -> DataFrame:
    """Live rows known but not downloaded."""
    return as_manifest(manifest).where("placeholder and not deleted")


def scan_diff(manifest: DataFrame, listing: DataFrame, hashes: DataFrame | None = None, keep_blocks: bool = False) -> DataFrame:
    """(folder_id, path, change, size, mtime) of a listing (folder_id, path, size, mtime).

    change: new, changed, candidate (same size, other time: only these need their content
    hashed), touched (a candidate whose blocks are the manifest's) or same. hashes:
    (folder_id, path, blocks) of hashed candidates, which settles them. keep_blocks: with the manifest's
    blocks, for sources/tree.py's settle_candidates(), which opens candidates only.
    """
    m = as_manifest(manifest).where("not deleted").select(*KEYS, F.struct("size", "mtime", "blocks", "placeholder").alias("e"))
    j = listing.select(*KEYS, "size", "mtime").join(m, KEYS, "left")
    e = F.col("e")
    change = F.when(e.isNull(), "new").when(unchanged(e["size"], e["mtime"], F.col("size"), F.col("mtime")), "same").when(e["size"] == F.col("size"), "candidate").otherwise("changed")
    j = j.withColumn("change", change)
    if hashes is not None:
        j = j.join(hashes.select(*KEYS, F.col("blocks").alias("_b")), KEYS, "left")
        settled = F.when((F.col("change") == "candidate") & F.col("_b").isNotNull(), F.when(F.col("_b") == e["blocks"], "touched").otherwise("changed")).otherwise(F.col("change"))
        j = j.withColumn("change", settled).drop("_b")
    return (j.withColumn("blocks", e["blocks"]) if keep_blocks else j).drop("e")


def tombstones(manifest: DataFrame, seen: DataFrame, device: str, rules: list[Rule] = (), nested: DataFrame | None = None) -> DataFrame:
    """Manifest rows that a scan no longer sees, as deleted rows with their version raised."""
    m = as_manifest(manifest).where("not deleted and not placeholder").where(~ignored_path(list(rules), "path"))
    m = m if nested is None else outside_nested_roots(m, nested)
    gone = m.join(seen.select(*KEYS), KEYS, "left_anti")
    none = F.array().cast("array<string>")
    return as_manifest(gone.withColumns({"version": increment_version("version", device), "deleted": F.lit(True), "size": F.lit(0), "blocks": none, "cdh": F.lit(None), "clens": F.lit(None), "mtime": F.lit(None)}))


def identity_verdict(folders: DataFrame, recorded: DataFrame) -> DataFrame:
    """(folder_id, verdict) of a root's (dev, ino), null if it can't be read, against what is
    recorded (folder_id, dev, ino, known_devs): ok, remounted-known, remounted, changed, missing, unknown.
    """
    r = recorded.select("folder_id", F.col("dev").alias("r_dev"), F.col("ino").alias("r_ino"), "known_devs")
    j = folders.select("folder_id", "dev", "ino").join(r, "folder_id", "left")
    known = F.coalesce(F.array_contains("known_devs", F.col("dev")), F.lit(False))
    verdict = (
        F.when(F.col("dev").isNull() | F.col("ino").isNull(), "missing")
        .when(F.col("r_ino").isNull(), "unknown")
        .when(F.col("ino") != F.col("r_ino"), "changed")
        .when(F.col("dev") == F.col("r_dev"), "ok")
        .when(known, "remounted-known")
        .otherwise("remounted")
    )
    return j.select("folder_id", verdict.alias("verdict"))


def mass_delete_guard(deletes: DataFrame, seen: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones to apply, refused ones with a reason).

    Refused: all of a folder whose identity is unknown when a scan saw no file of it, and
    any path that holds a backslash.
    """
    files = seen.groupBy("folder_id").agg(F.count("*").alias("_files"))
    j = deletes.join(files, "folder_id", "left").join(identity.select("folder_id", "verdict"), "folder_id", "left")
    blind = F.coalesce(F.col("_files"), F.lit(0)) == 0
    unsure = F.coalesce(F.col("verdict"), F.lit("unknown")) == "unknown"
    reason = F.when(blind & unsure, "no file seen in an unknown folder").when(F.instr("path", "\\") > 0, "backslash in path")
    j = j.withColumn("reason", reason).drop("_files", "verdict")
    return j.where("reason is null").drop("reason"), j.where("reason is not null")


def conflict_copies(listing: DataFrame, limit: int = 500) -> DataFrame:
    """(folder_id, path, original_path, device_id, size, mtime, truncated): the newest `limit` of each folder."""
    name = lambda i: F.regexp_extract("path", CONFLICT_COPY, i)
    found = listing.where(F.col("path").rlike(CONFLICT_COPY)).select(*KEYS, F.concat(name(1), name(3)).alias("original_path"), name(2).alias("device_id"), "size", "mtime")
    return truncated(found, limit, F.desc("mtime"), "path")


def conflict_counts(copies: DataFrame) -> DataFrame:
    return copies.groupBy("folder_id").agg(F.count("*").alias("n"))


def conflict_identical(copies: DataFrame, content: DataFrame, most: int = 32 << 20) -> DataFrame:
    """copies with `identical`: false by size, null if the original is missing or too large,
    else whether both have the same bytes. content: (folder_id, path, size, sha256)."""
    c = content.select(*KEYS, F.col("size").alias("_s"), F.col("sha256").alias("_h"))
    o = content.select("folder_id", F.col("path").alias("original_path"), F.col("size").alias("_os"), F.col("sha256").alias("_oh"))
    j = copies.join(c, KEYS, "left").join(o, ["folder_id", "original_path"], "left")
    same = F.when(F.col("_os").isNull(), F.lit(None)).when(F.col("_os") != F.col("size"), False).when(F.col("size") > most, F.lit(None)).otherwise(F.col("_h") == F.col("_oh"))
    return j.withColumn("identical", same.cast("boolean")).drop("_s", "_h", "_os", "_oh")


def clean_identical(checked: DataFrame) -> DataFrame:
    """(folder_id, cleaned): copies that can go."""
    return checked.where("identical").groupBy("folder_id").agg(F.count("*").alias("cleaned"))


def empty_dirs(dirs: DataFrame, files: DataFrame, rules: list[Rule] = (), nested: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """(folder_id, path, truncated): directories without a file anywhere below, `limit` of a folder at most.

    dirs: (folder_id, path) of every directory; files likewise. Files of ignored subtrees and
    nested roots count as content; directories in ignored subtrees aren't reported.
    """
    content = files.select("folder_id", F.explode(ancestors("path")).alias("path"))
    if nested is not None:
        content = content.unionByName(nested.select("folder_id", F.explode(F.concat(ancestors("dir"), F.array("dir"))).alias("path")))
    bare = dirs.select(*KEYS).join(content.distinct(), KEYS, "left_anti")
    up = F.concat(ancestors("path"), F.array("path"))
    shut = bare.select(*KEYS, F.explode(up).alias("dir")).where(ignored_path(list(rules), "dir", True)).select(*KEYS).distinct()
    return truncated(bare.join(shut, KEYS, "left_anti"), limit, "path")


def list_directory(listing: DataFrame, directory: str, held: DataFrame | None = None, limit: int = 2000) -> DataFrame:
    """(folder_id, name, is_dir, size, mtime, placeholder, truncated): immediate children,
    directories first, then by name, `limit` of a folder at most. held: placeholder rows (folder_id, path, size) to merge in."""
    rows = listing.select(*KEYS, "size", "mtime", F.lit(False).alias("placeholder"))
    if held is not None:
        rows = rows.unionByName(held.join(listing.select(*KEYS), KEYS, "left_anti").select(*KEYS, "size", F.lit(None).cast("bigint").alias("mtime"), F.lit(True).alias("placeholder")))
    prefix = f"{directory.rstrip('/')}/" if directory else ""
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    inside = rows.where(F.col("path").startswith(prefix)).withColumn("rest", rest).where("rest <> ''")
    child = F.substring_index("rest", "/", 1)
    deeper = F.instr("rest", "/") > 0
    each = inside.groupBy("folder_id", child.alias("name")).agg(
        F.bool_or(deeper).alias("is_dir"),
        F.max(F.when(~deeper, F.col("size"))).alias("size"),
        F.max(F.when(~deeper, F.col("mtime"))).alias("mtime"),
        F.bool_and("placeholder").alias("placeholder"),
    )
    each = each.withColumn("size", F.when(F.col("is_dir"), 0).otherwise(F.col("size")))
    return truncated(each, limit, F.desc("is_dir"), "name")
