"""Queries: history, reports, traffic, progress, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query

_COLS = ["seq", "folder_id", "path", "action", "direction", "device_id"]
_NAMES = ", ".join(_COLS)
_ACTIONS = ", ".join(f"count(*) FILTER (action = '{a}') AS \"{a}\"" for a in history.ACTIONS)
_FROM = "TIMESTAMP '2024-01-24 00:00:00'"
_W = f"{fx.EVENTS}, w AS (SELECT * FROM e WHERE ts >= {_FROM})"


def _folders(e):
    return e.select("folder_id").distinct().withColumn("folder_path", F.concat(F.lit("/srv/"), "folder_id"))


@query(f"WITH {fx.EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY seq DESC) AS i FROM e) SELECT {_NAMES} FROM n WHERE i <= 2000")
def last_events(spark, sf_dir):
    """What retention keeps: its cap is the feature."""
    return history.last_events(fx.events(spark, sf_dir)).select(*_COLS)


@query(f"WITH {fx.EVENTS} SELECT {_NAMES} FROM e WHERE direction = 'remote' AND action = 'update' AND contains(lower(path), 'p1')")
def history_filter(spark, sf_dir):
    return fx.events(spark, sf_dir).where(history.history_filter("remote", None, "update", "P1")).select(*_COLS)


@query(f"WITH {fx.EVENTS} SELECT folder_id, count(*) AS total, count(*) FILTER (device_id = 'd3') AS matched, arg_min(ts, seq) AS oldest_ts, 2000 AS retention FROM e GROUP BY folder_id")
def history_stats(spark, sf_dir):
    out = history.history_stats(fx.events(spark, sf_dir), history.history_filter(device_id="d3"))
    return out.withColumn("oldest_ts", F.col("oldest_ts").cast("timestamp_ntz"))


@query(f"WITH {fx.EVENTS} SELECT {_NAMES} FROM e")
def union_history(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return history.union_history(*[e.where(F.col("folder_id") == f) for f in ("f0", "f1", "f2", "f3")]).select(*_COLS)


@query(f"WITH {fx.EVENTS} SELECT {_NAMES}, '/srv/' || folder_id AS folder_path FROM e")
def history_with_folder(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return history.history_with_folder(e, _folders(e)).select(*_COLS, "folder_path")


@query(f"WITH {fx.EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS i FROM e) SELECT {_NAMES}, '/srv/' || folder_id AS folder_path FROM n WHERE i <= 200")
def global_history(spark, sf_dir):
    """The 200 newest events of all folders."""
    e = fx.events(spark, sf_dir)
    return history.global_history(e, _folders(e)).select(*_COLS, "folder_path")


@query(f"WITH {_W}, d AS (SELECT strftime(DATE '2024-01-24' + CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM range(7) t(i)) SELECT d.day, {_ACTIONS} FROM d LEFT JOIN w ON strftime(w.ts, '%Y-%m-%d') = d.day GROUP BY d.day")
def weekly_days(spark, sf_dir):
    return history.weekly_days(fx.events(spark, sf_dir), fx.NOW)


@query(f"WITH {_W} SELECT folder_id, {_ACTIONS}, count(*) AS total FROM w GROUP BY GROUPING SETS ((folder_id), ())")
def weekly_folders(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return history.weekly_folders(e, fx.NOW)


@query(f"WITH {_W} SELECT {_ACTIONS}, count(*) AS total FROM w")
def weekly_totals(spark, sf_dir):
    return history.weekly_totals(fx.events(spark, sf_dir), fx.NOW)


@query(f"WITH {_W} SELECT device_id, count(*) AS n FROM w WHERE direction = 'remote' AND device_id IS NOT NULL GROUP BY device_id")
def weekly_devices(spark, sf_dir):
    return history.weekly_devices(fx.events(spark, sf_dir), fx.NOW)


@query(f"""WITH {_W}, t AS (SELECT bool_or(o <= {_FROM} + INTERVAL 1 DAY) AS truncated FROM (SELECT min(ts) AS o FROM e GROUP BY folder_id)),
n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS i FROM w WHERE action = 'conflict') SELECT seq, folder_id, path, device_id, truncated FROM n, t WHERE i <= 50""")
def weekly_conflicts(spark, sf_dir):
    return history.weekly_conflicts(fx.events(spark, sf_dir), fx.NOW).drop("ts")


_SUM = "coalesce(CAST(sum(CASE WHEN direction = '{0}' AND bytes > 0 THEN bytes END) AS BIGINT), 0) AS {1}"
_BOTH = f"{_SUM.format('local', 'sent')}, {_SUM.format('remote', 'received')}"


@query(f"WITH {fx.EVENTS} SELECT folder_id, {_BOTH} FROM e GROUP BY folder_id")
def traffic_totals(spark, sf_dir):
    return history.traffic_totals(fx.events(spark, sf_dir), ("folder_id",))


_SAMPLES = f"""{fx.EVENTS}, x AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS start, {_BOTH} FROM e GROUP BY 1),
z AS (SELECT min(start) AS a, max(start) AS z FROM x), grid AS (SELECT unnest(generate_series(greatest(a, z - INTERVAL 1435 MINUTE), z, INTERVAL 5 MINUTE)) AS start FROM z),
smp AS (SELECT grid.start, coalesce(sent, 0) AS sent, coalesce(received, 0) AS received FROM grid LEFT JOIN x USING (start))"""


@query(f"WITH {_SAMPLES} SELECT epoch_ms(start) AS start_ms, sent, received FROM smp")
def traffic_samples(spark, sf_dir):
    """The last 288 windows of five minutes, without gaps."""
    return history.traffic_samples(fx.events(spark, sf_dir)).select(F.unix_millis("start").alias("start_ms"), "sent", "received")


@query(f"WITH {_SAMPLES} SELECT CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(received) AS BIGINT) AS received, max(greatest(sent, received)) AS peak FROM smp")
def traffic_24h(spark, sf_dir):
    return history.traffic_24h(history.traffic_samples(fx.events(spark, sf_dir)))


@query(f"WITH {fx.EVENTS}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC, seq DESC) AS i FROM e WHERE device_id IS NOT NULL) SELECT {_NAMES} FROM n WHERE i <= 100")
def recent_relays(spark, sf_dir):
    return history.recent_relays(fx.events(spark, sf_dir).where("device_id is not null")).select(*_COLS)


def _transfers(e):
    state = F.when(F.col("seq") % 4 == 0, "pending").when(F.col("seq") % 4 == 1, "sending").when(F.col("seq") % 4 == 2, "receiving").otherwise("idle")
    return e.select("folder_id", state.alias("state"), F.expr("bytes div 2").alias("bytes_done"), F.col("bytes").alias("bytes_total"))


_PROGRESS = """SELECT folder_id, count(*) FILTER (seq % 4 = 0) AS pending, count(*) FILTER (seq % 4 = 1) AS sending, count(*) FILTER (seq % 4 = 2) AS receiving, CAST(sum(bytes // 2) AS BIGINT) AS bytes_done, CAST(sum(bytes) AS BIGINT) AS bytes_total
FROM e WHERE seq % 4 < 3 GROUP BY folder_id"""


@query(f"WITH {fx.EVENTS} {_PROGRESS}")
def progress_counts(spark, sf_dir):
    return history.progress_counts(_transfers(fx.events(spark, sf_dir)))


@query(fx.duck(f"WITH l AS ({fx.M1_LOCAL}) SELECT folder_id, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS tombstones FROM l GROUP BY GROUPING SETS ((folder_id), ())"))
def entry_counts(spark, sf_dir):
    return history.entry_counts(fx.manifest(spark, sf_dir))


@query(fx.duck(f"""WITH l AS ({fx.M1_LOCAL}), e AS ({fx.M4}), c AS (SELECT folder_id, count(*) FILTER (NOT deleted) AS live, count(*) FILTER (deleted) AS tombstones FROM l GROUP BY folder_id), t AS (SELECT {_BOTH} FROM e), p AS ({_PROGRESS}),
x AS (SELECT folder_id, count(*) AS n FROM e WHERE action = 'conflict' GROUP BY folder_id)
SELECT 'index_entries' AS name, 'gauge' AS type, folder_id AS folder, CAST(live AS DOUBLE) AS value FROM c UNION ALL SELECT 'index_tombstones', 'gauge', folder_id, tombstones FROM c
UNION ALL SELECT 'traffic_sent_bytes', 'counter', NULL, sent FROM t UNION ALL SELECT 'traffic_received_bytes', 'counter', NULL, received FROM t UNION ALL SELECT 'conflict_copies', 'gauge', folder_id, n FROM x
UNION ALL SELECT 'transfers_pending', 'gauge', folder_id, pending FROM p UNION ALL SELECT 'transfers_sending', 'gauge', folder_id, sending FROM p UNION ALL SELECT 'transfers_receiving', 'gauge', folder_id, receiving FROM p
UNION ALL SELECT 'transfer_bytes_done', 'gauge', folder_id, bytes_done FROM p UNION ALL SELECT 'transfer_bytes_total', 'gauge', folder_id, bytes_total FROM p"""))
def metric_rows(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    conflicts = e.where("action = 'conflict'").groupBy("folder_id").agg(F.count("*").alias("n"))
    m = history.metric_rows(history.entry_counts(fx.manifest(spark, sf_dir)), history.traffic_totals(e), conflicts, history.progress_counts(_transfers(e)))
    return m.select("name", "type", F.try_element_at("labels", F.lit("folder")).alias("folder"), "value")


