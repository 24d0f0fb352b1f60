"""Workday calendars and sync schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import within_schedule


def calendar_lookup(rows: DataFrame, overrides: DataFrame, published: DataFrame, ts: str = "ts") -> DataFrame:
    """rows with day_type (workday, holiday, null if nobody says) and workday.

    An override counts before the published day, that before Monday to Friday. Both tables
    are (day, day_type) with one row a day, and small: Spark broadcasts what fits its limit.
    """
    day = F.to_date(ts)
    o = overrides.select(F.col("day").cast("date").alias("_day"), F.col("day_type").alias("_o"))
    p = published.select(F.col("day").cast("date").alias("_day"), F.col("day_type").alias("_p"))
    j = rows.withColumn("_day", day).join(o, "_day", "left").join(p, "_day", "left")
    kind = F.coalesce("_o", "_p")
    clock = F.dayofweek("_day").between(2, 6)
    return j.withColumn("day_type", kind).withColumn("workday", F.when(kind.isNotNull(), kind == "workday").otherwise(clock)).drop("_day", "_o", "_p")


def schedule_gate(rows: DataFrame, schedules: DataFrame, global_rules, ts: str = "ts") -> DataFrame:
    """rows (with workday) and `allowed`, `reason`: null, global or folder.

    schedules: (folder_id, rules), rules an array as within_schedule() has it; global_rules: such a column.
    """
    j = rows.join(schedules.select("folder_id", F.col("rules").alias("_r")), "folder_id", "left")
    whole = within_schedule(global_rules, ts, F.col("workday"))
    own = within_schedule("_r", ts, F.col("workday"))
    reason = F.when(~whole, "global").when(~own, "folder")
    return j.withColumn("allowed", whole & own).withColumn("reason", reason).drop("_r")


def topology_edges(members: DataFrame) -> DataFrame:
    """(a, b, folders): device pairs that share folders. members: (folder_id, device_id).

    Pairs meet inside each folder, whose devices are few, and are combined over folders.
    """
    m = members.select("folder_id", "device_id").distinct()
    a, b = m.withColumnRenamed("device_id", "a"), m.withColumnRenamed("device_id", "b")
    pairs = a.join(b, "folder_id").where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("folder_id")).alias("folders"))
