"""Structured Streaming jobs. Event times are timestamps (cast TIMESTAMP_NTZ first).

Rows later than the watermark are dropped; its delay is a parameter of each job. What a job keeps
for each key is in streaming/state.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.vectors import compare_versions, merge_versions
from tidemark.operators.common import KEYS, MANIFEST, as_manifest
from tidemark.operators.plan import upsert_manifest
from tidemark.session import ship_package
from tidemark.streaming import sink, state


def fold_deltas(current: DataFrame, deltas: DataFrame) -> DataFrame:
    """(folder_id, path, *manifest, conflict): current rows with deltas (and seq) folded in, in seq order.

    A newer version replaces, an older one is ignored, a concurrent one keeps the row with the
    merged vector and marks it. One shuffle by key; a key's deltas of one batch meet in a row.
    """
    cols = list(MANIFEST)
    new = deltas.select(*KEYS, "seq", *[(F.col(c) if c in deltas.columns else F.lit(None)).cast(k).alias(c) for c, k in MANIFEST.items()])
    rows = as_manifest(current).withColumn("seq", F.lit(-1).cast("bigint")).unionByName(new.fillna(False, ["deleted", "placeholder"]))
    listed = F.array_sort(
        F.collect_list(F.struct("seq", *[F.col(c) for c in cols])),
        lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0),
    )

    def step(acc, x):
        relation = compare_versions(acc["version"], x["version"])
        keep = lambda row, version, conflict: F.struct(version.alias("version"), *[row[c].alias(c) for c in cols[1:]], conflict.alias("conflict"))
        return (
            F.when(relation == "b-newer", keep(x, x["version"], F.lit(False)))
            .when(relation == "concurrent", keep(acc, merge_versions(acc["version"], x["version"]), F.lit(True)))
            .otherwise(keep(acc, acc["version"], acc["conflict"]))
        )

    g = rows.groupBy(*KEYS).agg(listed.alias("l"))
    first = F.get("l", 0)
    start = F.struct(first["version"].alias("version"), *[first[c].alias(c) for c in cols[1:]], F.lit(False).alias("conflict"))
    return g.withColumn("e", F.aggregate(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), start, step)).select(*KEYS, "e.*")


def _manifest_changes(deltas: DataFrame, initial: DataFrame) -> DataFrame:
    new = deltas.select(*KEYS, "seq", *[(F.col(c) if c in deltas.columns else F.lit(None)).cast(k).alias(c) for c, k in MANIFEST.items()])
    rows = state.flat(new.fillna(False, ["deleted", "placeholder"]), *KEYS, "seq").groupBy(*KEYS)
    first = state.flat(as_manifest(initial), *KEYS).groupBy(*KEYS)
    out = rows.transformWithStateInPandas(state.FoldDeltas(), f"folder_id string, path string, {state.FOLDED}", "Update", "None", initialState=first)
    rest = F.from_json("rest", state.REST).alias("rest")
    out = out.select(*KEYS, F.map_from_arrays("devices", "counts").alias("version"), rest, "conflict")
    return out.select(*KEYS, "version", "rest.*", "conflict").select(*KEYS, *MANIFEST, "conflict")


def apply_deltas(deltas: DataFrame, initial: DataFrame, base: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps a manifest current from a stream of deltas: fold_deltas() with each path's row in keyed state.

    Each trigger writes the rows that it changed to base/batch=<id>, and nothing else; a batch that is run
    again after a failure writes the same again. A trigger's deltas of one path are sorted by seq in a
    task's memory (set the source's limits accordingly); triggers are folded as they come. The manifest is
    current_manifest(initial, base).
    """
    ship_package(deltas.sparkSession)

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/batch={epoch}")

    with state.rocksdb(deltas.sparkSession):
        out = _manifest_changes(deltas, initial).writeStream.outputMode("update").foreachBatch(batch)
        return out.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_manifest(initial: DataFrame, base: str) -> DataFrame:
    """(folder_id, path, *manifest, conflict): the initial rows with each path's last change in place."""
    kinds = ", ".join(["folder_id string, path string", *(f"{c} {k}" for c, k in MANIFEST.items()), "conflict boolean, batch bigint"])
    changes = initial.sparkSession.read.schema(kinds).parquet(base)
    return upsert_manifest(as_manifest(initial).withColumn("conflict", F.lit(False)), changes.withColumnRenamed("batch", "seq"), "conflict")


def _waiting(rows: DataFrame, keys: list[str], processor, out: str, delay: str, target: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Appends what an InEventTime processor puts out, with ts, to a Parquet directory."""
    ship_package(rows.sparkSession)
    timed = rows.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    with state.rocksdb(rows.sparkSession):
        found = timed.groupBy(*keys).transformWithStateInPandas(state.Framed(processor), out, "Append", "EventTime")
        found = found.withColumn("ts", F.timestamp_micros("us")).drop("us")
        out_ = found.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        return out_.trigger(**(trigger or {"availableNow": True})).start()


def single_flight(offers: DataFrame, target: str, checkpoint: str, ttl: float = 300, delay: str = "5 minutes", **trigger) -> StreamingQuery:
    """Offers (ts, seq, folder_id, path, version_key, link[, released]) that may go on, in order of (ts, seq).

    An offer of a version that another link holds, since less than `ttl` seconds, is left out; any other one takes
    the path. A row with `released` ends its link's claim. An offer comes out once the watermark has passed it.
    """
    released = F.col("released") if "released" in offers.columns else F.lit(False)
    rows = offers.select("ts", *KEYS, F.col("seq").cast("bigint").alias("seq"), "version_key", "link", F.coalesce(released, F.lit(False)).alias("released"))
    kinds = "folder_id string, path string, version_key string, link string, us bigint, seq bigint"
    return _waiting(rows, KEYS, state.Claims(round(ttl * 1_000_000)), kinds, delay, target, checkpoint, trigger)


def traffic_5m(traffic: DataFrame, delay: str = "10 minutes", span: str = "5 minutes") -> DataFrame:
    """(start, direction, bytes): tumbling sums; bytes of 0 or less don't count."""
    t = traffic.where("bytes > 0").withWatermark("ts", delay)
    return t.groupBy(F.window("ts", span), "direction").agg(F.sum("bytes").alias("bytes")).select(F.col("window.start").alias("start"), "direction", "bytes")


def transfer_rate(traffic: DataFrame, delay: str = "10 seconds", span: int = 5) -> DataFrame:
    """(start, folder_id, bytes_per_second) over sliding windows of `span` seconds, one each second.

    The rate is over the time from the window's first bytes to its end, a second at least. In append mode a
    window comes out once the watermark has passed it; those still open when a stream ends come out in complete mode only.
    """
    t = traffic.where("bytes > 0").withWatermark("ts", delay)
    g = t.groupBy(F.window("ts", f"{span} seconds", "1 second"), "folder_id").agg(F.sum("bytes").alias("b"), F.min("ts").alias("first"))
    micros = F.greatest(F.unix_micros("window.end") - F.unix_micros("first"), F.lit(1_000_000))
    return g.select(F.col("window.start").alias("start"), "folder_id", F.round(F.col("b") * 1_000_000.0 / micros).cast("bigint").alias("bytes_per_second"))


def serving_sessions(requests: DataFrame, delay: str = "1 minute", gap: str = "15 seconds") -> DataFrame:
    """(folder_id, path, start, stop, requests): a file is being sent until `gap` after its last request.

    Open sessions: as open windows in transfer_rate().
    """
    g = requests.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), *KEYS).agg(F.count("*").alias("requests"))
    return g.select(*KEYS, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "requests")


def completed_folders(progress: DataFrame, target: str, checkpoint: str, delay: str = "1 minute", **trigger) -> StreamingQuery:
    """(folder_id, ts) whenever a folder goes from moving to idle, by rows (folder_id, ts, busy) in order of time.

    A time is settled, and comes out, once the watermark has passed it.
    """
    rows = progress.select("ts", "folder_id", "busy")
    return _waiting(rows, ["folder_id"], state.Completions(), "folder_id string, us bigint", delay, target, checkpoint, trigger)


def status_changes(statuses: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """(key, ts, status) whenever the newest status of a key in a trigger differs from the one put out last."""
    ship_package(statuses.sparkSession)
    with state.rocksdb(statuses.sparkSession):
        rows = statuses.select("key", F.unix_micros("ts").alias("us"), "status").groupBy("key")
        found = rows.transformWithState(state.Changes(), "key string, us bigint, status string", "Append", "None")
        out = found.select("key", F.timestamp_micros("us").alias("ts"), "status").writeStream.outputMode("append").format("parquet")
        return out.option("path", target).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def history_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, **trigger) -> StreamingQuery:
    """Continuous ingest of JSON-lines events into Parquet by folder."""
    events = spark.readStream.schema(schema).json(source)
    out = events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("folder_id")
    return out.trigger(**(trigger or {"availableNow": True})).start()


def alert_rows(events: DataFrame) -> DataFrame:
    """(ts, kind, folder_id, path) of events that somebody should see: conflicts, errors, completions."""
    kind = F.when(F.col("action") == "conflict", "conflict").when(F.col("action") == "error", "error").when(F.col("action") == "completed", "completed")
    return events.select("ts", kind.alias("kind"), *KEYS).where("kind is not null")


def alerts(events: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes alert rows to a sink that commits each batch once; read_alerts() gives them with their batch."""
    spark = events.sparkSession
    ship_package(spark)
    spark.dataSource.register(sink.AlertSource)
    out = alert_rows(events).writeStream.format(sink.FORMAT).option("path", target).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
