"""Queries: stored and wire manifests, calendars and schedules, topology, commits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import calendar, commits, plan
from tidemark.operators.common import KEYS
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query
from tidemark.session import shared_dir
from tidemark.sources import files, history_store, manifest

_M1 = fx.duck(f"l AS ({fx.M1_LOCAL}), r AS ({fx.M1_REMOTE})")


def _numbers(df):
    at = lambda d: F.coalesce(F.try_element_at("version", F.lit(d)), F.lit(0))
    return df.select(*KEYS, at("A").alias("va"), at("B").alias("vb"), "size", "deleted", F.array_join("blocks", ",").alias("blocks"), "mtime")


_ROWS = "folder_id, path, va, vb, size, deleted, CASE WHEN deleted THEN '' ELSE b0 END AS blocks, mtime"


def _stored(spark, sf_dir):
    """Rows as a database keeps them: JSON text, flags as 0 and 1; one row in 13 has a bad chunk view."""
    m = fx.manifest(spark, sf_dir)
    pair = lambda d: F.concat(F.lit(f'["{d}",'), F.element_at("version", d).cast("string"), F.lit("]"))
    return m.select(*KEYS, F.concat(F.lit("["), pair("A"), F.lit(","), pair("B"), F.lit("]")).alias("version"), "size", F.col("deleted").cast("int").alias("deleted"), F.to_json("blocks").alias("blocks"), F.when(F.col("size") % 13 == 0, "[1").otherwise('["h"]').alias("cdh"), F.lit("[5]").alias("clens"), "mtime")


@query(f"WITH {_M1} SELECT {_ROWS}, size % 13 <> 0 AS chunked FROM l")
def read_manifest(spark, sf_dir):
    m = manifest.read_manifest(_stored(spark, sf_dir))
    return _numbers(m).join(m.select(*KEYS, F.col("cdh").isNotNull().alias("chunked")), KEYS)


@query(f"""WITH {_M1} SELECT folder_id, path, '{{"path":"' || path || '","version":[["A",' || va || '],["B",' || vb || ']],"size":' || size || ',"deleted":' || deleted || ',"blocks":[' || CASE WHEN deleted THEN '' ELSE '"' || b0 || '"' END || '],"mtime":' || mtime || '}}' AS json FROM l""")
def encode_manifest(spark, sf_dir):
    return manifest.encode_manifest(fx.manifest(spark, sf_dir))


@query(f"WITH {_M1} SELECT {_ROWS} FROM l")
def decode_manifest(spark, sf_dir):
    """Wire messages of one entry each, decoded again."""
    sent = manifest.encode_manifest(fx.manifest(spark, sf_dir)).select("folder_id", F.concat(F.lit("["), "json", F.lit("]")).alias("body"))
    return _numbers(manifest.decode_manifest(sent))


_JSON = """'{"path":"' || path || '","version":[["A",' || va || '],["B",' || vb || ']],"size":' || size || ',"deleted":' || deleted || ',"blocks":[' || CASE WHEN deleted THEN '' ELSE '"' || b0 || '"' END || '],"mtime":' || mtime || '}'"""


@query(f"""WITH RECURSIVE {_M1}, z AS (SELECT folder_id, path, strlen({_JSON}) AS n, row_number() OVER (PARTITION BY folder_id ORDER BY path) AS i FROM l),
s AS (SELECT folder_id, path, i, 0 AS shard, 2 + n AS used FROM z WHERE i = 1
 UNION ALL SELECT z.folder_id, z.path, z.i, s.shard + CASE WHEN s.used + 1 + n > 4096 THEN 1 ELSE 0 END, CASE WHEN s.used + 1 + n > 4096 THEN 2 + n ELSE s.used + 1 + n END FROM s JOIN z ON z.folder_id = s.folder_id AND z.i = s.i + 1)
SELECT folder_id, path, '0-' || shard AS shard FROM s""")
def shard_manifest(spark, sf_dir):
    """Shards of up to 4 KiB, each folder in one part: which entry goes to which."""
    return manifest.shard_manifest(fx.manifest(spark, sf_dir), 4096, 1 << 30).select(*KEYS, "shard")


@query(f"WITH {_M1} SELECT folder_id, count(*) AS entries, 0 AS too_large FROM l GROUP BY folder_id")
def shard_sizes(spark, sf_dir):
    """Entries of all shards, in parts of about 500 paths, and shards of several entries whose encoding passes 4 KiB."""
    s = manifest.shard_manifest(fx.manifest(spark, sf_dir), 4096, 500)
    each = s.groupBy("folder_id", "shard").agg(F.count("*").alias("n"), (F.sum(F.octet_length("json") + 1) + 1).alias("bytes"))
    return each.groupBy("folder_id").agg(F.sum("n").alias("entries"), F.count_if((F.col("bytes") > 4096) & (F.col("n") > 1)).cast("int").alias("too_large"))


@query(f"WITH {_M1} SELECT {_ROWS} FROM r UNION ALL SELECT {_ROWS} FROM l ANTI JOIN r USING (folder_id, path)")
def upsert_manifest(spark, sf_dir):
    l, r = fx.manifest(spark, sf_dir), fx.manifest(spark, sf_dir, True)
    old = r.withColumns({"size": F.lit(-1).cast("bigint"), "seq": F.lit(1)})
    return _numbers(plan.upsert_manifest(l, old.unionByName(r.withColumn("seq", F.lit(2)))))


@query(f"WITH {fx.EVENTS} SELECT folder_id, path, action, direction, device_id, epoch_us(ts) // 1000 AS ms FROM e")
def read_history(spark, sf_dir):
    """Histories appended as JSON lines in the shared folder, and read again."""
    where = f"{shared_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}"
    files.append_history(fx.events(spark, sf_dir), where)
    good, _ = files.read_history(spark, f"{where}/*")
    return good.select("folder_id", "path", "action", "direction", "device_id", F.unix_millis("ts").alias("ms"))


def append_history(spark, sf_dir):
    """The same, with one bad line added to a folder: counts of good and bad lines."""
    where = f"{shared_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}"
    files.append_history(fx.events(spark, sf_dir), where)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(f"{where}/folder_id=f0")
    good, bad = files.read_history(spark, f"{where}/*")
    return good.groupBy("folder_id").agg(F.count("*").alias("good")).join(bad.agg(F.sum("bad_lines").alias("bad")))


query(f"WITH {fx.EVENTS} SELECT folder_id, count(*) AS good, CAST(1 AS BIGINT) AS bad FROM e GROUP BY folder_id")(append_history)


@query(f"WITH {fx.EVENTS} SELECT seq, folder_id, path, action, direction, device_id, epoch_us(ts) // 1000 AS ms FROM e QUALIFY row_number() OVER (PARTITION BY folder_id ORDER BY seq DESC) <= 100")
def compact_history(spark, sf_dir):
    """Events appended in four parts, trimmed to each folder's last hundred in between and at the end."""
    where = f"{shared_dir(spark).rstrip('/')}/history/{uuid.uuid4().hex}"
    e = fx.events(spark, sf_dir)
    lo, hi = e.agg(F.min("seq"), F.max("seq")).first()
    for k in range(4):
        history_store.append_events(e.where(F.floor((F.col("seq") - lo) * 4 / (hi - lo + 1)) == k), where)
        if k % 2:
            history_store.compact_history(spark, where, 100)
    return history_store.read_store(spark, where).select("seq.n", "folder_id", "path", "action", "direction", "device_id", F.unix_millis("ts").alias("ms")).withColumnRenamed("n", "seq")


def _calendar(spark):
    body = '{"days": [{"date": "2024-01-01", "isOffDay": true}, {"date": "2024-02-30", "isOffDay": true}, {"date": "2024-01-13", "isOffDay": false}, {"date": "2024-01-14", "isOffDay": "no"}]}'
    flat = '{"2024-01-15": true, "2024-01-20": false, "2024-13-01": true, "note": "x"}'
    days = files.parse_calendar(spark.createDataFrame([(body,), (flat,)], "body string"))
    return spark.createDataFrame([("2024-01-06", "workday")], "day string, day_type string"), days


_CAL = f"""{fx.EVENTS}, c AS (SELECT *, CAST(ts AS DATE) AS day, CASE CAST(CAST(ts AS DATE) AS VARCHAR) WHEN '2024-01-06' THEN 'workday' WHEN '2024-01-01' THEN 'holiday' WHEN '2024-01-13' THEN 'workday' WHEN '2024-01-15' THEN 'holiday' WHEN '2024-01-20' THEN 'workday' END AS day_type FROM e),
k AS (SELECT *, CASE WHEN day_type IS NULL THEN isodow(day) < 6 ELSE day_type = 'workday' END AS workday, hour(ts) * 60 + minute(ts) AS m FROM c)"""


@query(f"WITH {_CAL} SELECT seq, day_type, workday FROM k")
def calendar_lookup(spark, sf_dir):
    return calendar.calendar_lookup(fx.events(spark, sf_dir), *_calendar(spark)).select("seq", "day_type", "workday")


@query(f"WITH {_CAL} SELECT CAST(day AS VARCHAR) AS day, any_value(day_type) AS day_type FROM k WHERE day_type IS NOT NULL AND day <> DATE '2024-01-06' GROUP BY day")
def read_calendar(spark, sf_dir):
    """Published days that events fall on."""
    days = fx.events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    return _calendar(spark)[1].join(days, "day").withColumn("day", F.col("day").cast("string"))


def _rules(*rules):
    window = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("stop"))
    return F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*[F.lit(d) for d in days]).cast("array<int>").alias("days"), F.array(*[window(*w) for w in ws]).alias("windows")) for k, days, ws in rules])


_NIGHT = "(isodow(day) >= 6 AND (m >= 1320 OR m < 360))"


@query(f"""WITH {_CAL}, x AS (SELECT *, (workday AND m >= 540 AND m < 1080) OR {_NIGHT} AS g, CASE folder_id WHEN 'f1' THEN m >= 600 AND m < 720 WHEN 'f2' THEN NOT workday ELSE true END AS f FROM k)
SELECT seq, g AND f AS allowed, CASE WHEN NOT g THEN 'global' WHEN NOT f THEN 'folder' END AS reason FROM x""")
def schedule_gate(spark, sf_dir):
    rows = calendar.calendar_lookup(fx.events(spark, sf_dir), *_calendar(spark))
    whole = _rules(("workday", [], [(540, 1080)]), ("dow", [0, 6], [(1320, 360)]))
    own = F.when(F.col("folder_id") == "f1", _rules(("any", [], [(600, 720)]))).when(F.col("folder_id") == "f2", _rules(("offday", [], [(0, 1440)])))
    schedules = rows.select("folder_id").distinct().withColumn("rules", own)
    return calendar.schedule_gate(rows, schedules, whole).select("seq", "allowed", "reason")


@query(fx.duck(f"WITH m AS ({fx.M7}) SELECT a.device_id AS a, b.device_id AS b, string_agg(a.folder_id, ',' ORDER BY a.folder_id) AS folders FROM m a JOIN m b ON a.folder_id = b.folder_id AND a.device_id < b.device_id GROUP BY ALL"))
def topology_edges(spark, sf_dir):
    return calendar.topology_edges(fx.members(spark, sf_dir)).withColumn("folders", F.array_join("folders", ","))


def _commits(spark, sf_dir):
    c = fx.table(spark, sf_dir, "conversations")
    folder = F.concat(F.lit("f"), (F.col("conv_id") % 4).cast("string"))
    hash_ = F.sha2(F.concat_ws(":", "conv_id", "turn"), 256)
    return c.select(folder.alias("folder_id"), hash_.alias("hash"), (F.col("conv_id") * 1000 + F.col("turn")).alias("date"), F.col("role").alias("author"), "turn", "text")


_C = "c AS (SELECT 'f' || conv_id % 4 AS folder_id, sha256(conv_id || ':' || turn) AS hash, conv_id * 1000 + turn AS date, role AS author, turn, text FROM conversations)"


@query(f"WITH {_C} SELECT hash, author, split_part(text, chr(10), 1) AS subject, 'more' || chr(31) || 'text' AS body FROM c")
def read_commit_log(spark, sf_dir):
    c = _commits(spark, sf_dir)
    subject = F.split_part("text", F.lit("\n"), F.lit(1))
    line = F.concat_ws("\x1f", "hash", "author", F.col("date").cast("string"), F.lit("HEAD"), subject, F.lit("\n more"), F.lit("text \n"))
    return files.parse_commit_log(c.select(line.alias("value"))).select("hash", "author", "subject", "body")


@query(f"WITH {_C} SELECT hash, 'M' AS status, 'a b.txt' AS path, CAST(NULL AS VARCHAR) AS orig_path FROM c UNION ALL SELECT hash, 'R100', 'new.txt', 'old.txt' FROM c WHERE turn % 2 = 0")
def read_commit_files(spark, sf_dir):
    c = _commits(spark, sf_dir)
    value = F.when(F.col("turn") % 2 == 0, F.lit("M\0a b.txt\0R100\0old.txt\0new.txt\0")).otherwise(F.lit("M\0a b.txt\0"))
    return files.parse_commit_files(c.select("hash", value.alias("value")))


@query(f"WITH {_C} SELECT hash, date FROM c ORDER BY date DESC, hash LIMIT 20 OFFSET 40")
def commit_page(spark, sf_dir):
    """The third page: paging is the feature."""
    return commits.commit_page(_commits(spark, sf_dir), 20, 40).select("hash", "date")


@query(f"""WITH {_C}, n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY date DESC, hash) AS i, count(*) OVER (PARTITION BY folder_id) AS total FROM c WHERE turn % 3 = 0)
SELECT folder_id, hash, total, total > 50 AS truncated FROM n WHERE i <= 50""")
def unpushed_commits(spark, sf_dir):
    """The newest 50 of each folder, with the whole count."""
    c = _commits(spark, sf_dir)
    return commits.unpushed_commits(c, c.where("turn % 3 <> 0")).select("folder_id", "hash", "total", "truncated")


@query(f"WITH {_C} SELECT hash, CASE WHEN turn % 2 = 0 THEN trim(split_part(text, chr(10), 1)) || chr(10) || 'end' ELSE trim(split_part(text, chr(10), 1)) || chr(10) || chr(10) END AS message FROM c")
def strip_trailer(spark, sf_dir):
    first = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    with_trailer = F.concat(first, F.lit("\nCo-Authored-By: A <a@b.c>\n\n  \nend\ncoauthored-by: B\n\n"))
    c = _commits(spark, sf_dir).select("hash", F.when(F.col("turn") % 2 == 0, with_trailer).otherwise(F.concat(first, F.lit("\n\n"))).alias("m"))
    return c.select("hash", scalars.strip_trailer("m").alias("message"))


@query(f"""WITH {_C} SELECT folder_id, count(*) FILTER (turn % 5 = 0) AS deleted, count(*) FILTER (turn % 5 = 1) AS renamed, count(*) FILTER (turn % 5 IN (2, 3)) AS added, count(*) FILTER (turn % 5 = 4) AS modified,
 count(*) FILTER (turn % 5 <= 2) AS staged FROM c GROUP BY folder_id""")
def git_change_counts(spark, sf_dir):
    c = _commits(spark, sf_dir)
    rec = F.element_at(F.array(F.lit("D  gone"), F.lit("R  new\0old"), F.lit("A  add"), F.lit("?? dir/"), F.lit(" M mod")), (F.col("turn") % 5 + 1).cast("int"))
    export = F.floor(F.col("date") / 1000)  # a conversation
    exported = c.groupBy("folder_id", export.alias("export_id")).agg(F.concat(F.array_join(F.collect_list(rec), "\0"), F.lit("\0")).alias("output"))
    return commits.git_change_counts(commits.git_entries(exported))


@query(f"WITH {_M1} SELECT l.folder_id, split_part(l.path, '/', 1) AS commit_id, bool_and(CASE WHEN l.deleted THEN r.path IS NULL WHEN r.path IS NULL OR l.size <> r.size THEN false ELSE l.b0 = r.b0 END) AS aligned FROM l LEFT JOIN (SELECT * FROM r WHERE NOT deleted) r ON l.folder_id = r.folder_id AND l.path = r.path GROUP BY ALL")
def worktree_aligned(spark, sf_dir):
    l, r = fx.manifest(spark, sf_dir), fx.manifest(spark, sf_dir, True)
    changed = l.select(*KEYS, F.split_part("path", F.lit("/"), F.lit(1)).alias("commit_id"))
    return commits.worktree_aligned(changed, l, r.where("not deleted"))


@query(f"WITH {fx.EVENTS} SELECT seq, strftime(ts, '%Y-%m-%d') AS day, path LIKE 'p1%' AS real FROM e")
def day_key(spark, sf_dir):
    text = F.when(F.col("path").startswith("p1"), "2024-02-29").when(F.col("path").startswith("p2"), "2023-02-29").otherwise("2024-2-1")
    return fx.events(spark, sf_dir).select("seq", scalars.day_key("ts").alias("day"), scalars.is_real_date(text).alias("real"))
