"""Files as tables: listings, archives of versions and trash, histories, commit logs, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ignore import TOOL, Rule
from tidemark.functions.scalars import is_real_date
from tidemark.operators.common import parsed_lists
from tidemark.session import ship_package
from tidemark.sources import tree

EVENT = "ts bigint, folderId string, path string, action string, direction string, deviceId string, durationMs bigint"


def scan_files(spark: SparkSession, root: str, folder_id: str, rules: list[Rule] = (), glob: str | None = None, nested: DataFrame | None = None, tool: str = TOOL) -> DataFrame:
    """(folder_id, path, size, mtime) of a tree, walked by tasks; ignored directories and nested roots aren't listed, no file is opened."""
    return tree.walk(spark, root, folder_id, rules, nested, glob, tool)[0]


def base36(text: Column | str) -> Column:
    return F.conv(text, 36, 10).cast("bigint")


def parse_version_names(listing: DataFrame, tool: str = TOOL) -> DataFrame:
    """(folder_id, path, file, ts) of files named <path>.<tool>-v-<base-36 ms>[.<n>]."""
    name = rf"(?s)^(.*)\.{tool}-v-([0-9a-z]+)(\.[0-9]+)?$"
    part = lambda i: F.regexp_extract(F.col("path"), name, i)
    return listing.where(F.col("path").rlike(name)).select("folder_id", part(1).alias("path"), F.col("path").alias("file"), base36(part(2)).alias("ts"))


def parse_trash_names(listing: DataFrame, tool: str = TOOL) -> DataFrame:
    """(folder_id, path, file, ts, size) of files named <path>.<base-36 ms>[.<n>], newest first.

    A stamp has 8 to 13 letters and is at least 1e11; version names don't count.
    """
    name = r"(?s)^(.*)\.([0-9a-z]{8,13})(\.[0-9]+)?$"
    part = lambda i: F.regexp_extract(F.col("path"), name, i)
    rows = listing.where(F.col("path").rlike(name)).select("folder_id", part(1).alias("path"), F.col("path").alias("file"), base36(part(2)).alias("ts"), "size")
    return rows.where((F.col("ts") >= 10**11) & ~F.col("path").endswith(f".{tool}-v-"[:-1])).orderBy(F.desc("ts"), "file")


def read_version_archive(spark: SparkSession, root: str, folder_id: str, tool: str = TOOL) -> DataFrame:
    return parse_version_names(scan_files(spark, root, folder_id), tool)


def read_trash_archive(spark: SparkSession, root: str, folder_id: str, tool: str = TOOL) -> DataFrame:
    return parse_trash_names(scan_files(spark, root, folder_id), tool)


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines by file) of JSON-lines histories.

    Good lines of a file with a bad one are kept. seq is (file, line order): within a file, append order.
    """
    raw = spark.read.schema(f"{EVENT}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_name"))
    good = F.col("_corrupt_record").isNull() & F.col("path").isNotNull() & F.col("ts").isNotNull()
    events = raw.where(good).select(F.monotonically_increasing_id().alias("seq"), F.timestamp_millis("ts").alias("ts"), F.col("folderId").alias("folder_id"), "path", "action", "direction", F.col("deviceId").alias("device_id"), F.col("durationMs").alias("duration_ms"))
    return events, raw.where(~good).groupBy("file").agg(F.count("*").alias("bad_lines"))


def append_history(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines by folder; compaction is last_events() written anew."""
    out = events.select(F.unix_millis("ts").alias("ts"), F.col("folder_id").alias("folderId"), "path", "action", "direction", F.col("device_id").alias("deviceId"), "folder_id")
    out.write.mode("append").partitionBy("folder_id").json(path)


def parse_commit_log(records: DataFrame, column: str = "value") -> DataFrame:
    """(.., hash, author, date, refs, subject, body) of records with six 0x1f-separated fields; the
    body keeps later separators."""
    f = F.split(column, "\x1f", 6)
    names = ("hash", "author", "date", "refs", "subject")
    rest = [c for c in records.columns if c != column]
    get = lambda i: F.coalesce(F.get(f, i), F.lit(""))
    return records.where(F.col(column) != "").select(*rest, *[get(i).alias(n) for i, n in enumerate(names)], F.regexp_replace(get(5), r"^\s+|\s+$", "").alias("body"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of an exported log with NUL-separated records."""
    return parse_commit_log(spark.read.text(path, lineSep="\0"))


def parse_commit_files(records: DataFrame, column: str = "value") -> DataFrame:
    """(.., status, path, orig_path) of NUL-separated name-status fields, one commit a row.

    Renames and copies (R, C) have two paths, the old one first.
    """
    rest = [c for c in records.columns if c != column]
    ship_package(records.sparkSession)
    return records.select(*rest, F.inline(parsed_lists(_name_status, "status", "path", "orig_path")(column)))


def _name_status(text: str):
    """A text's entries; they end at an empty field."""
    fields = iter(text.split("\0"))
    for status in fields:
        if not status:
            return
        orig = next(fields, "") if status[0] in "RC" else None
        path = "" if orig == "" else next(fields, "")
        if not path:
            return
        yield status, path, orig


def parse_calendar(payloads: DataFrame, column: str = "body") -> DataFrame:
    """(day, day_type) of JSON payloads: {"days": [{"date", "isOffDay"}]} or {"date": true if off}.

    Dates that don't exist, and flags that aren't booleans, are dropped.
    """
    listed = F.from_json(column, "struct<days:array<struct<date:string,isOffDay:boolean>>>")["days"]
    flat = F.from_json(column, "map<string,string>")
    of_flat = F.transform(F.filter(F.map_entries(flat), lambda e: e["value"].isin("true", "false")), lambda e: F.struct(e["key"].alias("date"), (e["value"] == "true").alias("isOffDay")))
    rows = payloads.select(F.inline(F.when(F.get_json_object(column, "$.days").startswith("["), listed).otherwise(of_flat)))
    good = rows.where(is_real_date("date") & F.col("isOffDay").isNotNull())
    return good.select(F.to_date("date").alias("day"), F.when(F.col("isOffDay"), "holiday").otherwise("workday").alias("day_type"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Days of one payload a file."""
    return parse_calendar(spark.read.text(path, wholetext=True), "value")
