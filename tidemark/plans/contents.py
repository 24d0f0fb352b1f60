"""Queries: blocks, chunks, transfers of content, slots on disk."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import assembly, chunking, drift, ranges
from tidemark.operators.common import KEYS
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query
from tidemark.session import shared_dir
from tidemark.sources import tree

PIECE = 512
_B = f"{fx.SLOTS}, o AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY path ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM b)"
_HAVE = f"{_B}, f AS (SELECT path, local_hash, min((slot, place)) AS first FROM o GROUP BY ALL)"


@query(f"WITH {_B} SELECT folder_id, path, slot, remote_hash AS hash, length FROM o WHERE remote_hash <> local_hash")
def missing_blocks(spark, sf_dir):
    return chunking.missing_blocks(fx.slots(spark, sf_dir, "remote"), fx.slots(spark, sf_dir, "local")).drop("offset")


@query(f"WITH {_HAVE} SELECT folder_id, o.path, slot, remote_hash AS hash, length FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.path = o.path AND f.local_hash = o.remote_hash)")
def missing_chunks(spark, sf_dir):
    return chunking.missing_chunks(fx.slots(spark, sf_dir, "remote"), fx.slots(spark, sf_dir, "local")).select(*KEYS, "slot", "hash", "length")


@query(f"WITH {_B} SELECT folder_id, path, local_hash AS hash, CAST(min(slot) AS INTEGER) AS slot, min(place) AS \"offset\" FROM o GROUP BY ALL")
def first_chunk(spark, sf_dir):
    return chunking.first_chunk(fx.slots(spark, sf_dir, "local"))


@query(f"WITH {_B} SELECT folder_id, path, remote_hash AS hash FROM o INTERSECT SELECT folder_id, path, local_hash FROM o")
def shared_chunks(spark, sf_dir):
    return chunking.shared_chunks(fx.slots(spark, sf_dir, "remote"), fx.slots(spark, sf_dir, "local"))


@query(f"""WITH {_HAVE} SELECT folder_id, o.path, CAST(sum(CASE WHEN f.path IS NOT NULL THEN length ELSE 0 END) AS BIGINT) AS chunks_reused, CAST(sum(CASE WHEN f.path IS NULL THEN length ELSE 0 END) AS BIGINT) AS chunks_sent,
 CAST(sum(CASE WHEN remote_hash = o.local_hash THEN length ELSE 0 END) AS BIGINT) AS blocks_reused FROM o LEFT JOIN f ON f.path = o.path AND f.local_hash = o.remote_hash GROUP BY ALL""")
def chunk_reuse(spark, sf_dir):
    r, l, tasks = fx.slots(spark, sf_dir, "remote", False), fx.slots(spark, sf_dir, "local", False), fx.slot_tasks(spark, sf_dir)
    by_hash = chunking.chunk_reuse(r, l, False, tasks).select(*KEYS, F.col("reused").alias("chunks_reused"), F.col("sent").alias("chunks_sent"))
    return by_hash.join(chunking.chunk_reuse(r, l, True, tasks).select(*KEYS, F.col("reused").alias("blocks_reused")), KEYS)


@query(f"WITH {_B} SELECT folder_id, path, slot, place AS \"offset\", length FROM o")
def slot_layout(spark, sf_dir):
    lens = F.transform(F.array_sort(F.collect_list(F.struct("slot", "length"))), lambda s: s["length"])
    return drift.slot_layout(fx.slots(spark, sf_dir, "local").groupBy(*KEYS).agg(lens.alias("lens")))


@query(fx.duck(f"""WITH l AS ({fx.M1_LOCAL}), s AS (SELECT folder_id, path, size, unnest(range(CAST(ceil(size / 65536.0) AS BIGINT))) AS i FROM l WHERE size > 0)
SELECT folder_id, path, CAST(i AS INTEGER) AS slot, i * 65536 AS "offset", least(65536, size - i * 65536) AS length FROM s"""))
def fixed_layout(spark, sf_dir):
    return drift.fixed_layout(fx.manifest(spark, sf_dir), 65536)


_DOCS = "d AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, encode(text) AS raw FROM documents)"
_PIECES = f"""{_DOCS}, h AS (SELECT path, hex(raw) AS hx, octet_length(raw) AS size FROM d), p AS (SELECT path, size, CAST(unnest(range(CAST(ceil(size / {PIECE}.0) AS BIGINT))) AS INTEGER) AS slot, hx FROM h),
q AS (SELECT path, size, slot, unhex(substr(hx, slot * {2 * PIECE} + 1, {2 * PIECE})) AS piece FROM p)"""


@query(f"WITH {_PIECES} SELECT 'f0' AS folder_id, path, slot, CAST(slot AS BIGINT) * {PIECE} AS \"offset\", octet_length(piece) AS length, sha256(piece) AS hash FROM q")
def fixed_blocks(spark, sf_dir):
    return chunking.fixed_blocks(fx.content(spark, sf_dir), PIECE)


LEAST, MOST, BITS = 256, 4096, 9  # small, since documents are


def _cdc(files):
    """DuckDB: CTEs of the content-defined chunks of files (path, raw); a byte's number is turned back by its place, so a window of XORs slides."""
    low = lambda x: f"(({x}) & 4294967295::HUGEINT)"
    rotl = lambda x, r: f"((({x}) & ((1::BIGINT << (32 - ({r}))) - 1)) << ({r})) | (({x}) >> (32 - ({r})))"
    return f"""RECURSIVE c AS ({files}), k AS (SELECT path, hex(raw) AS hx, octet_length(raw) AS size FROM c),
s AS (SELECT b, (2654435769 + 1831565813 * (b + 1)) & 4294967295 AS s FROM range(256) r(b)),
t AS (SELECT b, {low('xor(s, s >> 15)::HUGEINT * (s | 1)::HUGEINT')}::BIGINT AS t FROM s),
u AS (SELECT b, xor(t, {low("t::HUGEINT + xor(t, t >> 7)::HUGEINT * (t | 61)::HUGEINT")}::BIGINT) AS t FROM t),
gear AS (SELECT upper(printf('%02x', b)) AS h, xor(t, t >> 14) AS g FROM u),
e AS (SELECT path, regexp_extract_all(hx, '..') AS hs FROM k), y AS (SELECT path, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM e),
z AS (SELECT path, i, {rotl('g', '(32 - i % 32) % 32')} AS g FROM y JOIN gear USING (h)),
w AS (SELECT path, i, bit_xor(g) OVER (PARTITION BY path ORDER BY i ROWS 31 PRECEDING) AS g FROM z),
m AS (SELECT path, list(i + 1 ORDER BY i) AS marks FROM w WHERE ({rotl('g', 'i % 32')}) & {(1 << BITS) - 1} = 0 GROUP BY path),
p AS MATERIALIZED (SELECT k.path, size, marks FROM k LEFT JOIN m USING (path)),
cuts AS (SELECT path, -1 AS slot, 0::BIGINT AS start, 0::BIGINT AS stop FROM p WHERE size > 0
 UNION ALL SELECT cuts.path, slot + 1, stop, least(coalesce(list_filter(marks, lambda x: x >= stop + {LEAST})[1], size), stop + {MOST}, size) FROM cuts JOIN p USING (path) WHERE stop < size),
chunks AS (SELECT path, CAST(slot AS INTEGER) AS slot, start AS "offset", stop - start AS length, sha256(unhex(substr(hx, 2 * start + 1, 2 * (stop - start)))) AS hash FROM cuts JOIN k USING (path) WHERE slot >= 0)"""


@query(f"""WITH {_cdc(f"WITH {_DOCS} SELECT * FROM d")} SELECT 'f0' AS folder_id, path, slot, "offset", length, hash FROM chunks""")
def cdc_chunks(spark, sf_dir):
    return chunking.cdc_chunks(fx.content(spark, sf_dir), LEAST, MOST, (1 << BITS) - 1)


_SOURCES = "SELECT source AS path, encode(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS raw FROM documents GROUP BY source"


def _big_files(spark, sf_dir):
    """A file for each source, of all its documents."""
    base = f"{shared_dir(spark).rstrip('/')}/tree/{uuid.uuid4().hex}"
    d = fx.table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    d.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value").write.partitionBy("source").text(base)
    return tree.walk(spark, base, "f0", glob="*.txt")[0], {"f0": base}


def _by_source(slots):
    return slots.withColumn("path", F.regexp_extract("path", "source=([^/]*)/", 1))


@query(f"""WITH {_cdc(_SOURCES)} SELECT 'f0' AS folder_id, path, slot, "offset", length, hash FROM chunks""")
def cdc_chunks_of_files(spark, sf_dir):
    """Large files, each read as ranges of 10,000 bytes by many tasks."""
    files, roots = _big_files(spark, sf_dir)
    return _by_source(ranges.cdc_chunks_of_files(files, roots, LEAST, MOST, (1 << BITS) - 1, 10_000))


@query(f"""WITH c AS ({_SOURCES}), h AS (SELECT path, hex(raw) AS hx, octet_length(raw) AS size FROM c), p AS (SELECT path, size, CAST(unnest(range(CAST(ceil(size / 65536.0) AS BIGINT))) AS INTEGER) AS slot, hx FROM h)
SELECT 'f0' AS folder_id, path, slot, CAST(slot AS BIGINT) * 65536 AS "offset", least(65536, size - slot * 65536) AS length, sha256(unhex(substr(hx, slot * 131072 + 1, 131072))) AS hash FROM p""")
def fixed_blocks_of_files(spark, sf_dir):
    files, roots = _big_files(spark, sf_dir)
    return _by_source(ranges.fixed_blocks_of_files(files, roots, 65536))


@query(f"""WITH {_cdc(f"WITH {_DOCS} SELECT * FROM d")}, x AS (SELECT path, count(*) AS n_chunks, string_agg(hash, ',' ORDER BY slot) AS cdh, string_agg(length::VARCHAR, ',' ORDER BY slot) AS clens FROM chunks GROUP BY path),
pieces AS (SELECT path, CAST(unnest(range(CAST(ceil(size / {PIECE}.0) AS BIGINT))) AS INTEGER) AS slot, hx FROM k), v AS (SELECT path, count(*) AS n_blocks, string_agg(sha256(unhex(substr(hx, slot * {2 * PIECE} + 1, {2 * PIECE}))), ',' ORDER BY slot) AS blocks FROM pieces GROUP BY path)
SELECT 'f0' AS folder_id, k.path, size, CAST(n_blocks AS INTEGER) AS n_blocks, CAST(n_chunks AS INTEGER) AS n_chunks, sha256(concat_ws(chr(0), size::VARCHAR, blocks, cdh, clens)) AS fingerprint FROM k JOIN x USING (path) JOIN v USING (path)""")
def file_views(spark, sf_dir):
    v = chunking.file_views(fx.content(spark, sf_dir), PIECE, LEAST, MOST, (1 << BITS) - 1)
    return v.select(*KEYS, "size", F.size("blocks").alias("n_blocks"), F.size("cdh").alias("n_chunks"), scalars.entry_fingerprint("size", "blocks", "cdh", "clens").alias("fingerprint"))


@query(f"WITH {_DOCS} SELECT 'f0' AS folder_id, path, octet_length(raw) % 10 <> 0 AS ok FROM d")
def verify_blocks(spark, sf_dir):
    c = fx.content(spark, sf_dir)
    m = chunking._lists(chunking.fixed_blocks(c, PIECE), "blocks").join(c.select(*KEYS, F.length("content").alias("n")), KEYS)
    spoiled = m.withColumn("blocks", F.when(F.col("n") % 10 == 0, F.concat("blocks", F.array(F.lit("x")))).otherwise(F.col("blocks")))
    return chunking.verify_blocks(spoiled, c, PIECE)


@query(f"WITH {_DOCS} SELECT 'f0' AS folder_id, path, sha256(raw) AS sha256, octet_length(raw) AS size FROM d WHERE octet_length(raw) > 0")
def reassemble(spark, sf_dir):
    """Files written by tasks from their slots, some of which come twice."""
    c = fx.content(spark, sf_dir)
    s = chunking.fixed_blocks(c, PIECE)
    data = s.join(c, KEYS).select(*KEYS, "slot", F.expr(f"substring(content, cast(slot * {PIECE} + 1 as int), {PIECE})").alias("data"))
    twice = data.unionByName(data.where("slot % 7 = 0"))
    out = assembly.assemble_files(twice, chunking._lists(s, "hashes"), {"f0": f"{shared_dir(spark).rstrip('/')}/tree/{uuid.uuid4().hex}"})
    return out.where("reason is null").select(*KEYS, "sha256", "size")


@query(f"WITH {_PIECES} SELECT 'f0' AS folder_id, path, count(*) AS slots_held, CAST(sum(octet_length(piece)) AS BIGINT) AS bytes_held FROM q WHERE slot % 3 = 0 GROUP BY path")
def partial_progress(spark, sf_dir):
    c = fx.content(spark, sf_dir).select(*KEYS, F.length("content").alias("size"))
    layout = drift.fixed_layout(c, PIECE)
    return chunking.partial_progress(layout, layout.where("slot % 3 = 0"), c)


@query("""WITH x AS (SELECT concat_ws('/', source, lang, doc_id || '.txt') AS path, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT path, line, count(*) AS o, count(*) FILTER (length(line) % 5 <> 0) + count(*) FILTER (length(line) % 7 = 0) AS n FROM x GROUP BY path, line)
SELECT 'f0' AS folder_id, path, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS added, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS removed FROM g GROUP BY path""")
def line_delta(spark, sf_dir):
    d = fx.content(spark, sf_dir).select(*KEYS, F.col("content").cast("string").alias("text"))
    parts = F.split("text", "\n", -1)
    twice = F.flatten(F.transform(parts, lambda s: F.array_repeat(s, F.when(F.length(s) % 5 != 0, 1).otherwise(0) + F.when(F.length(s) % 7 == 0, 1).otherwise(0))))
    new = d.withColumn("text", F.when(F.size(twice) > 0, F.array_join(twice, "\n")))
    out = chunking.line_delta(d, new.where("text is not null"))
    return out.select(*KEYS, F.col("added").cast("bigint").alias("added"), F.col("removed").cast("bigint").alias("removed"))


@query(f"""WITH {_DOCS}, n AS (SELECT *, row_number() OVER (ORDER BY substr(md5(path), 1, 2), path) - 1 AS i, count(*) OVER () AS c, CAST(ceil(octet_length(raw) / {PIECE}.0) AS BIGINT) AS slots FROM d WHERE octet_length(raw) > 0),
s AS (SELECT *, CAST(CASE WHEN slots <= 1 THEN 0 ELSE CAST(('0x' || substr(sha256(path || ':1'), 1, 8)) AS BIGINT) % slots END AS INTEGER) AS slot FROM n WHERE i % greatest(1, CAST(ceil(c / 100.0) AS BIGINT)) = 1 % greatest(1, CAST(ceil(c / 100.0) AS BIGINT)))
SELECT 'f0' AS folder_id, path, slot, CASE WHEN octet_length(raw) % 4 = 0 THEN 'unreadable' WHEN octet_length(raw) % 4 = 1 THEN 'drift' ELSE 'ok' END AS verdict FROM s""")
def slot_verify(spark, sf_dir):
    """A round of 100 sampled slots: sampling is the operator."""
    c = fx.content(spark, sf_dir)
    m = chunking._lists(chunking.fixed_blocks(c, PIECE), "blocks").join(c.select(*KEYS, F.length("content").cast("bigint").alias("size")), KEYS)
    disk = c.where(F.length("content") % 4 != 0).withColumn("content", F.when(F.length("content") % 4 == 1, F.expr("cast(translate(cast(content as string), 'eaniEANI', 'xxxxxxxx') as binary)")).otherwise(F.col("content")))
    return drift.slot_verify(drift.local_samples(m, 100, 1), disk, PIECE)
