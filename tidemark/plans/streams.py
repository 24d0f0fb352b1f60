"""Queries: streaming jobs, run over the events until they are done, and what they wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators.common import KEYS
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query
from tidemark.session import shared_dir
from tidemark.streaming import jobs, sink

_PARTITIONS = "spark.sql.shuffle.partitions"


def _base(spark):
    return f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _stream(spark, sf_dir):
    """M4 as a stream of files, whether the events are one file or a folder."""
    base, events = _base(spark), fx.table(spark, sf_dir, "events")
    events.write.parquet(base)
    return spark.sql(fx.M4, events=spark.readStream.schema(events.schema).parquet(base))


def _done(stream, mode="append"):
    """Runs a stream over all there is and reads what it wrote: each batch, or the last in complete mode."""
    spark, base = stream.sparkSession, _base(stream.sparkSession)

    def batch(df, epoch):
        df.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else epoch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").drop("batch")


def _pieces(df, by, n=4):
    """df's rows in n pieces of rising `by` (a whole number), each to be written when the stream has done with those before."""
    lo, hi = df.agg(F.min(by), F.max(by)).first()
    piece = F.floor((by - F.lit(lo)) * n / (F.lit(hi) - F.lit(lo) + 1))
    return [df.where(piece == k) for k in range(n)]


def _in_pieces(spark, df, by, start):
    """Runs a stream that start(rows so far as a stream, base) gives for each piece, from the same checkpoint on; gives base."""
    base, before = _base(spark), spark.conf.get(_PARTITIONS)
    for piece in _pieces(df, by):
        piece.write.mode("append").parquet(f"{base}/in")
        # a stream keeps the number of state partitions that it starts with: one for each core here
        spark.conf.set(_PARTITIONS, min(int(before), spark.sparkContext.defaultParallelism))
        try:
            query_ = start(spark.readStream.schema(df.schema).parquet(f"{base}/in"), base)
        finally:
            spark.conf.set(_PARTITIONS, before)
        query_.awaitTermination()
    return base


@query(f"WITH {fx.EVENTS} SELECT epoch_ms(time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01')) AS start_ms, direction, CAST(sum(bytes) AS BIGINT) AS bytes FROM e WHERE bytes > 0 GROUP BY ALL")
def traffic_5m(spark, sf_dir):
    out = _done(jobs.traffic_5m(_stream(spark, sf_dir)), "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "direction", "bytes")


@query(f"""WITH {fx.EVENTS}, w AS (SELECT epoch_us(ts) // 1000000 - k AS s, epoch_us(ts) AS us, folder_id, bytes FROM e, range(5) r(k) WHERE bytes > 0)
SELECT 1000 * s AS start_ms, folder_id, CAST(round(sum(bytes) * 1000000.0::DOUBLE / greatest((s + 5) * 1000000 - min(us), 1000000)) AS BIGINT) AS bytes_per_second FROM w GROUP BY s, folder_id""")
def transfer_rate(spark, sf_dir):
    out = _done(jobs.transfer_rate(_stream(spark, sf_dir)), "complete")
    return out.select(F.unix_millis("start").alias("start_ms"), "folder_id", "bytes_per_second")


@query(f"""WITH {fx.EVENTS}, g AS (SELECT folder_id, path, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER p > 900000000, true) AS new FROM e WINDOW p AS (PARTITION BY folder_id, path ORDER BY ts)),
s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY folder_id, path ORDER BY us) AS session FROM g)
SELECT folder_id, path, min(us) AS start_us, max(us) + 900000000 AS stop_us, count(*) AS requests FROM s GROUP BY folder_id, path, session""")
def serving_sessions(spark, sf_dir):
    out = _done(jobs.serving_sessions(_stream(spark, sf_dir), gap="15 minutes"), "complete")
    return out.select(*KEYS, F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "requests")


#: Rows arrive up to 16 hours out of order; the watermark waits for two days, and settles what lies before it in the end.
_ARRIVES = "unix_millis(ts) + pmod(seq, 3) * 8 * 3600000"
_DELAY_MS = 2 * 86_400_000
_SETTLED = f"epoch_us(ts) < 1000 * ((SELECT max(epoch_us(ts)) // 1000 FROM e) - {_DELAY_MS})"


@query(f"""WITH RECURSIVE {fx.EVENTS}, o AS (SELECT seq, folder_id, path, bytes % 3 AS k, coalesce(device_id, 'local') AS link, action = 'delete' AS rel, epoch_us(ts) AS us,
 row_number() OVER (PARTITION BY folder_id, path ORDER BY ts, seq) AS i FROM e WHERE {_SETTLED}),
f AS (SELECT DISTINCT NULL::BIGINT AS seq, folder_id, path, 0::BIGINT AS i, false AS taken, NULL::BIGINT AS k, NULL::VARCHAR AS link, NULL::BIGINT AS us FROM o
 UNION ALL SELECT seq, folder_id, path, i, taken, CASE WHEN taken THEN k WHEN NOT ends THEN hk END, CASE WHEN taken THEN link WHEN NOT ends THEN hlink END, CASE WHEN taken THEN us WHEN NOT ends THEN hus END
 FROM (SELECT o.*, f.k AS hk, f.link AS hlink, f.us AS hus, NOT o.rel AND NOT coalesce(o.k = f.k AND o.link <> f.link AND o.us - f.us < 21600000000, false) AS taken, o.rel AND coalesce(o.k = f.k AND o.link = f.link, false) AS ends
  FROM f JOIN o ON o.folder_id = f.folder_id AND o.path = f.path AND o.i = f.i + 1))
SELECT seq, folder_id, path FROM f WHERE taken""")
def single_flight(spark, sf_dir):
    """Offers of three versions of each path by several links, and releases; a claim holds for six hours; four runs of the stream."""
    size = F.col("bytes") % 3
    none = F.lit(None).cast("array<string>")
    key = scalars.version_key(F.lit(False), scalars.entry_fingerprint(size, F.array(size.cast("string")), none, none))
    offers = fx.events(spark, sf_dir).select("seq", "ts", *KEYS, key.alias("version_key"), F.coalesce("device_id", F.lit("local")).alias("link"), F.expr("action = 'delete'").alias("released"))
    base = _in_pieces(spark, offers, F.expr(_ARRIVES), lambda s, b: jobs.single_flight(s, f"{b}/out", f"{b}/checkpoint", 6 * 3600, "2 days"))
    return spark.read.parquet(f"{base}/out").select("seq", *KEYS)


@query(f"""WITH {fx.EVENTS}, p AS (SELECT folder_id, ts, action = 'update' AS busy FROM e WHERE {_SETTLED}), w AS (SELECT *, lag(busy) OVER (PARTITION BY folder_id ORDER BY ts, busy) AS was FROM p)
SELECT folder_id, epoch_us(ts) AS us FROM w WHERE was AND NOT busy""")
def completed_folders(spark, sf_dir):
    """Four runs of the stream over events that arrive out of order."""
    progress = fx.events(spark, sf_dir).select("seq", "folder_id", "ts", F.expr("action = 'update'").alias("busy"))
    base = _in_pieces(spark, progress, F.expr(_ARRIVES), lambda s, b: jobs.completed_folders(s, f"{b}/out", f"{b}/checkpoint", "2 days"))
    return spark.read.parquet(f"{base}/out").select("folder_id", F.unix_micros("ts").alias("us"))


@query(f"""WITH {fx.EVENTS}, m AS (SELECT min(seq) AS lo, max(seq) AS hi FROM e), p AS (SELECT path AS key, epoch_us(ts) AS us, action AS status, 4 * (seq - lo) // (hi - lo + 1) AS piece FROM e, m),
n AS (SELECT key, piece, max(us) AS us, arg_max(status, (us, status)) AS status FROM p GROUP BY ALL)
SELECT key, us, status FROM n QUALIFY status IS DISTINCT FROM lag(status) OVER (PARTITION BY key ORDER BY piece)""")
def status_changes(spark, sf_dir):
    """Four triggers: the newest status of each path in each, where it isn't the one before."""
    s = fx.events(spark, sf_dir).select("seq", F.col("path").alias("key"), "ts", F.col("action").alias("status"))
    base = _in_pieces(spark, s, F.col("seq"), lambda rows, b: jobs.status_changes(rows, f"{b}/out", f"{b}/checkpoint"))
    return spark.read.parquet(f"{base}/out").select("key", F.unix_micros("ts").alias("us"), "status")


_SHOWN = "SELECT event_id AS seq, CAST(ts AS TIMESTAMP) AS ts, 'f' || CAST(user_id % 4 AS STRING) AS folder_id, 'p' || CAST(user_id % 50 AS STRING) || '.txt' AS path, CASE event_type WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'conflict' ELSE 'update' END AS action FROM {events}"


@query(fx.duck(f"WITH e AS ({_SHOWN}), m AS (SELECT min(seq) AS lo, max(seq) AS hi FROM e) SELECT action AS kind, folder_id, path, epoch_us(ts) // 1000 AS ms, CAST(4 * (seq - lo) // (hi - lo + 1) AS BIGINT) AS batch FROM e, m WHERE action <> 'update'"))
def alerts(spark, sf_dir):
    """All three kinds, in four batches."""
    shown = fx.spark_sql(spark, sf_dir, _SHOWN)
    base = _in_pieces(spark, shown, F.col("seq"), lambda rows, b: jobs.alerts(rows, f"{b}/out", f"{b}/checkpoint"))
    out = sink.read_alerts(spark, f"{base}/out", "ts timestamp, kind string, folder_id string, path string")
    return out.select("kind", *KEYS, F.unix_millis("ts").alias("ms"), "batch")


@query(f"WITH {fx.EVENTS} SELECT seq, folder_id, path, action FROM e")
def history_stream(spark, sf_dir):
    """Events written as JSON lines, ingested as a stream into Parquet by folder."""
    base = _base(spark)
    fx.events(spark, sf_dir).write.json(f"{base}/in")
    jobs.history_stream(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", "seq bigint, folder_id string, path string, action string").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("seq", *KEYS, "action")


@query(f"""WITH RECURSIVE {fx.EVENTS}, d AS (SELECT seq, folder_id, path, bytes, CAST(count(*) FILTER (direction = 'local') OVER w AS BIGINT) AS a, CAST(count(*) FILTER (direction = 'remote') OVER w AS BIGINT) AS b, row_number() OVER w AS i FROM e
 WINDOW w AS (PARTITION BY folder_id, path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
t AS (SELECT seq, folder_id, path, bytes, i, a, CASE WHEN seq % 5 = 0 THEN greatest(b - 1, 0) ELSE b END AS b FROM d),
f AS (SELECT folder_id, path, i, a AS va, b AS vb, bytes AS size, false AS conflict FROM t WHERE i = 1
 UNION ALL SELECT f.folder_id, f.path, t.i, greatest(f.va, t.a), greatest(f.vb, t.b), CASE WHEN t.a >= f.va AND t.b >= f.vb AND (t.a > f.va OR t.b > f.vb) THEN t.bytes ELSE f.size END,
  CASE WHEN t.a >= f.va AND t.b >= f.vb AND (t.a > f.va OR t.b > f.vb) THEN false WHEN f.va >= t.a AND f.vb >= t.b THEN f.conflict ELSE true END
 FROM f JOIN t ON t.folder_id = f.folder_id AND t.path = f.path AND t.i = f.i + 1)
SELECT folder_id, path, va, vb, size, conflict FROM f QUALIFY row_number() OVER (PARTITION BY folder_id, path ORDER BY i DESC) = 1""")
def apply_deltas(spark, sf_dir):
    """Deltas whose vectors count a path's events so far, every fifth without the last remote one: some are concurrent. Four runs of the stream."""
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda d: F.count_if(F.col("direction") == d).over(w)
    stale = F.when(F.col("seq") % 5 == 0, 1).otherwise(0)
    deltas = fx.events(spark, sf_dir).select("seq", *KEYS, count("local").alias("a"), F.greatest(count("remote") - stale, F.lit(0)).alias("b"), "bytes")
    deltas = deltas.select("seq", *KEYS, F.create_map(F.lit("A"), F.col("a"), F.lit("B"), F.col("b")).alias("version"), F.col("bytes").alias("size"), F.lit(False).alias("deleted"))
    at = f"{_base(spark)}/deltas"
    deltas.write.parquet(at)  # else each of the four pieces would count all events again
    deltas = spark.read.schema(deltas.schema).parquet(at)
    none = deltas.drop("seq").limit(0)
    base = _in_pieces(spark, deltas, F.col("seq"), lambda s, b: jobs.apply_deltas(s, none, f"{b}/out", f"{b}/checkpoint"))
    out = jobs.current_manifest(none, f"{base}/out")
    return out.select(*KEYS, F.element_at("version", "A").alias("va"), F.element_at("version", "B").alias("vb"), "size", "conflict")
