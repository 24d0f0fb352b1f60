"""Sync history, activity reports and traffic.

Events: seq (append order), ts (timestamp), folder_id, path, action, direction, device_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("add", "update", "delete", "conflict")
MAX_EVENTS = 2000


def last_events(events: DataFrame, n: int = MAX_EVENTS) -> DataFrame:
    """The last n events of each folder in append order. The rank filter is applied in map
    tasks first, so a busy folder sends n rows a task."""
    w = Window.partitionBy("folder_id").orderBy(F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def history_filter(direction: str | None = None, device_id: str | None = None, action: str | None = None, query: str | None = None) -> Column:
    """A condition on events; absent parts let all through, query is a case-blind substring of path."""
    on = F.lit(True)
    for name, value in (("direction", direction), ("device_id", device_id), ("action", action)):
        if value:
            on = on & F.coalesce(F.col(name) == value, F.lit(False))
    return on & F.contains(F.lower("path"), F.lit(query.lower())) if query else on


def history_stats(events: DataFrame, condition: Column, retention: int = MAX_EVENTS) -> DataFrame:
    """(folder_id, total, matched, oldest_ts, retention)."""
    return events.groupBy("folder_id").agg(F.count("*").alias("total"), F.count_if(condition).alias("matched"), F.min_by("ts", "seq").alias("oldest_ts"), F.lit(retention).alias("retention"))


def union_history(*histories: DataFrame) -> DataFrame:
    out = histories[0]
    for h in histories[1:]:
        out = out.unionByName(h, allowMissingColumns=True)
    return out


def history_with_folder(events: DataFrame, folders: DataFrame) -> DataFrame:
    """events with folder_path. folders: (folder_id, folder_path); Spark broadcasts it if it is small."""
    return events.join(folders.select("folder_id", "folder_path"), "folder_id")


def global_history(events: DataFrame, folders: DataFrame, n: int = 200, condition: Column | None = None) -> DataFrame:
    """The n newest events over all folders: a top-n, so each task keeps n."""
    e = events if condition is None else events.where(condition)
    return history_with_folder(e.orderBy(F.desc("ts"), F.desc("seq")).limit(n), folders).orderBy(F.desc("ts"), F.desc("seq"))


def window_start(now: str) -> Column:
    """Midnight six calendar days before `now`, in the session's time zone."""
    return F.date_sub(F.to_date(F.lit(now)), 6).cast("timestamp")


def _in_window(events: DataFrame, now: str) -> DataFrame:
    return events.where(F.col("ts") >= window_start(now))


def weekly_days(events: DataFrame, now: str) -> DataFrame:
    """(day, add, update, delete, conflict): seven days, without gaps."""
    spark = events.sparkSession
    days = spark.range(7).select(F.date_add(F.date_sub(F.to_date(F.lit(now)), 6), F.col("id").cast("int")).alias("day"))
    each = _in_window(events, now).groupBy(F.to_date("ts").alias("day")).agg(*[F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])
    return days.join(each, "day", "left").fillna(0, list(ACTIONS)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), *ACTIONS)


def weekly_folders(events: DataFrame, now: str, folders: DataFrame | None = None) -> DataFrame:
    """(folder_id, add, update, delete, conflict, total), busiest first; folder_id null is the sum
    of all. Folders without events come from `folders`."""
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    each = _in_window(events, now).rollup("folder_id").agg(*counts, F.count("*").alias("total"), F.grouping("folder_id").alias("_all"))
    each = each.drop("_all")
    if folders is not None:
        idle = folders.select("folder_id").join(each.select("folder_id"), "folder_id", "left_anti")
        each = each.unionByName(idle.select("folder_id", *[F.lit(0).cast("bigint").alias(c) for c in (*ACTIONS, "total")]))
    return each


def weekly_totals(events: DataFrame, now: str) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS]
    return _in_window(events, now).agg(*counts, F.count("*").alias("total"))


def weekly_devices(events: DataFrame, now: str) -> DataFrame:
    remote = _in_window(events, now).where("direction = 'remote' and device_id is not null")
    return remote.groupBy("device_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "device_id")


def weekly_conflicts(events: DataFrame, now: str, n: int = 50) -> DataFrame:
    """The newest n conflicts, with whether any folder's kept history may begin inside the window."""
    oldest = events.groupBy("folder_id").agg(F.min("ts").alias("t"))
    cut = oldest.agg(F.coalesce(F.bool_or(F.col("t") <= window_start(now) + F.expr("interval 1 day")), F.lit(False)).alias("truncated"))
    top = _in_window(events, now).where("action = 'conflict'").select("ts", "seq", "folder_id", "path", "device_id").orderBy(F.desc("ts"), F.desc("seq")).limit(n)
    return top.join(F.broadcast(cut))  # one row


def traffic_totals(traffic: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(*keys, sent, received) of (direction, bytes); bytes of 0 or less don't count."""
    some = lambda d: F.coalesce(F.sum(F.when((F.col("direction") == d) & (F.col("bytes") > 0), F.col("bytes"))), F.lit(0))
    aggregated = [some("local").alias("sent"), some("remote").alias("received")]
    return traffic.groupBy(*keys).agg(*aggregated) if keys else traffic.agg(*aggregated)


def traffic_samples(traffic: DataFrame, minutes: int = 5, keep: int = 288) -> DataFrame:
    """(start, sent, received) for each window up to the last one, zero where nothing moved; the last `keep`."""
    span = f"{minutes} minutes"
    each = traffic.groupBy(F.window("ts", span).alias("w")).agg(*[F.coalesce(F.sum(F.when((F.col("direction") == d) & (F.col("bytes") > 0), F.col("bytes"))), F.lit(0)).alias(n) for d, n in (("local", "sent"), ("remote", "received"))])
    each = each.select(F.col("w.start").alias("start"), "sent", "received")
    ends = each.agg(F.min("start").alias("a"), F.max("start").alias("z"))
    first = F.greatest(F.col("a"), F.col("z") - F.expr(f"interval {minutes * (keep - 1)} minutes"))
    grid = ends.where("z is not null").select(F.explode(F.sequence(first, F.col("z"), F.expr(f"interval {span}"))).alias("start"))
    return grid.join(each, "start", "left").fillna(0, ["sent", "received"])


def traffic_24h(samples: DataFrame) -> DataFrame:
    """(sent, received, peak): sums of the kept samples, and the largest one of either direction."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return samples.agg(total("sent"), total("received"), F.coalesce(F.max(F.greatest("sent", "received")), F.lit(0)).alias("peak"))


def recent_relays(relays: DataFrame, n: int = 100) -> DataFrame:
    return relays.orderBy(F.desc("ts"), F.desc("seq")).limit(n)


def progress_counts(transfers: DataFrame) -> DataFrame:
    """(folder_id, pending, sending, receiving, bytes_done, bytes_total) of folders that move something.

    transfers: (folder_id, state, bytes_done, bytes_total), state pending, sending, receiving or idle.
    """
    states = ("pending", "sending", "receiving")
    busy = transfers.where(F.col("state").isin(*states))
    return busy.groupBy("folder_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in states], F.sum("bytes_done").alias("bytes_done"), F.sum("bytes_total").alias("bytes_total"))


def entry_counts(manifest: DataFrame) -> DataFrame:
    """(folder_id, live, tombstones), and the sum of all with folder_id null."""
    return manifest.rollup("folder_id").agg(F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))


def metric_rows(counts: DataFrame, traffic: DataFrame, conflicts: DataFrame, progress: DataFrame) -> DataFrame:
    """(name, type, labels, value): gauges and counters of a status; missing numbers are 0."""
    folder = F.create_map(F.lit("folder"), F.col("folder_id"))
    none = F.expr("cast(map() as map<string,string>)")

    def rows(df, labels, kind, **names):
        return df.select(labels.alias("labels"), F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(kind).alias("type"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for n, c in names.items()]))).select("name", "type", "labels", "value")

    out = rows(counts.where("folder_id is not null"), folder, "gauge", index_entries="live", index_tombstones="tombstones")
    out = out.unionByName(rows(traffic, none, "counter", traffic_sent_bytes="sent", traffic_received_bytes="received"))
    out = out.unionByName(rows(conflicts, folder, "gauge", conflict_copies="n"))
    return out.unionByName(rows(progress, folder, "gauge", transfers_pending="pending", transfers_sending="sending", transfers_receiving="receiving", transfer_bytes_done="bytes_done", transfer_bytes_total="bytes_total"))


def metric_text(metrics: DataFrame) -> DataFrame:
    """(value): one exposition line for each metric row."""
    pair = F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), F.regexp_replace(F.regexp_replace(e["value"], r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))
    labels = F.when(F.size(pair) > 0, F.concat(F.lit("{"), F.array_join(F.array_sort(pair), ","), F.lit("}"))).otherwise("")
    return metrics.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("value"))
