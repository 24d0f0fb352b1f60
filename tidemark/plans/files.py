"""Queries: ignore rules, scans, listings, conflict copies, rollback, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import ignore, scalars
from tidemark.functions.rulelist import last_rule
from tidemark.operators import chunking, rollback, rules, scan
from tidemark.operators.common import KEYS
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query
from tidemark.session import shared_dir
from tidemark.sources import files as sources
from tidemark.sources import tree

RULES = ignore.parse_rules(fx.RULES)
#: DuckDB: the fixture's rules by hand, from the last to the first.
_LAST = r"""CASE WHEN regexp_matches(path, '^(.*/)?es/.*$') THEN '**/es/**' WHEN regexp_matches(path, '^de/7[^/]*(/.*)?$') THEN 'de/7*'
 WHEN regexp_matches(path, '^blog[^/]*(/.*)?$') THEN '/blog*' WHEN regexp_matches(path, '^(.*/)?fr/.*$') THEN 'fr/'
 WHEN regexp_matches(path, '^(.*/)?en/.*$') THEN 'en/' WHEN regexp_matches(path, '^(.*/)?[^/]*\.example\.org/.*$') THEN '*.example.org/' END"""
_G = f"{fx.PAGES}, v AS (SELECT *, {_LAST} AS last FROM g)"


@query(f"WITH {_G} SELECT page_id, path, coalesce(last <> 'fr/', false) AS ignored FROM v")
def ignored(spark, sf_dir):
    return fx.pages(spark, sf_dir).select("page_id", "path", ignore.ignored(RULES, "path").alias("ignored"))


@query(f"WITH {_G} SELECT page_id, path, CASE WHEN last <> 'fr/' THEN last END AS rule FROM v")
def matching_rule(spark, sf_dir):
    return fx.pages(spark, sf_dir).select("page_id", "path", ignore.matching_rule(RULES, "path").alias("rule"))


@query(f"WITH {_G} SELECT page_id, path, last AS rule FROM v")
def ignored_by_table(spark, sf_dir):
    """The form for long lists: the deciding rule by one automaton, with 5,000 rules before it that never match."""
    padded = [ignore.Rule(f"never{i}/*.x{i}") for i in range(5000)] + RULES
    p = fx.pages(spark, sf_dir).select("page_id", "path", last_rule(padded)("path").alias("place"))
    pattern = F.get(F.array(*[F.lit(r.pattern) for r in RULES]), F.col("place") - 5000)
    return p.select("page_id", "path", F.when(F.col("place") >= 0, pattern).alias("rule"))


_ODD = "CASE page_id % 7 WHEN 0 THEN path || '/.GIT/config' WHEN 1 THEN path || '/x.sync-conflict-k3-ABCDEFGHIJ.txt' WHEN 2 THEN path || '/a.tidemark-TMP' WHEN 3 THEN '.github/' || path WHEN 4 THEN 'a\\.svn\\' || path ELSE path END"


@query(f"WITH {_G} SELECT page_id, page_id % 7 IN (0, 1, 2, 4) AS hard FROM v")
def hard_ignored(spark, sf_dir):
    odd = _ODD.replace("\\", "\\\\")
    return fx.pages(spark, sf_dir).select("page_id", ignore.hard_ignored(F.expr(odd)).alias("hard"))


@query(f"WITH {_G} SELECT page_id, path, coalesce(last <> 'fr/', false) AS ignored, false AS hard, CASE WHEN last <> 'fr/' THEN last END AS rule, CASE WHEN last = 'fr/' THEN last END AS negated_rule FROM v")
def explain_ignore(spark, sf_dir):
    return fx.pages(spark, sf_dir).select("page_id", "path", ignore.explain_ignore(RULES, "path").alias("e")).select("page_id", "path", "e.*")


#: Rule files: one at each root, one for each host, one for each language of a host; in shut directories they don't count.
_RULE_FILES = f"""{_G}, t AS (SELECT page_id, folder_id, path, split_part(path, '/', 1) AS host, split_part(path, '/', 2) AS lang, split_part(path, '/', 3) AS name FROM v),
k AS (SELECT *, length(host) % 2 = 0 AS even, starts_with(host, 'blog.') AS blog, host = 'spam-farm.example.org' AS spam FROM t),
r AS (SELECT page_id, path, CASE WHEN spam THEN '' WHEN NOT (even AND lang = 'en') AND left(name, 1) IN ('5', '6') THEN host || '/' || lang WHEN blog AND name LIKE '%.html' THEN host WHEN even AND lang = 'en' THEN host WHEN name LIKE '%.html' THEN '' END AS dir,
 CASE WHEN spam THEN '/spam-farm.example.org/' WHEN NOT (even AND lang = 'en') AND left(name, 1) = '5' THEN '/5*' WHEN NOT (even AND lang = 'en') AND left(name, 1) = '6' THEN '/6*' WHEN blog AND name LIKE '%.html' THEN '*.html' WHEN even AND lang = 'en' THEN 'en/' WHEN name LIKE '%.html' THEN '*.html' END AS pattern,
 spam OR CASE WHEN NOT (even AND lang = 'en') AND left(name, 1) = '5' THEN true WHEN NOT (even AND lang = 'en') AND left(name, 1) = '6' THEN false WHEN blog AND name LIKE '%.html' THEN false WHEN even AND lang = 'en' THEN true ELSE name LIKE '%.html' END AS ignored FROM k)
SELECT page_id, path, dir, pattern, ignored FROM r"""


def _by_rule_files(spark, sf_dir, few_bytes):
    p = fx.pages(spark, sf_dir)
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i))
    host, lang = part(1), F.concat_ws("/", part(1), part(2))
    row = lambda d, lines: F.struct(d.alias("dir"), lines.alias("lines"))
    at_host = F.concat(F.when(F.length(host) % 2 == 0, F.array(F.lit("en/"))).otherwise(F.array(F.lit("# none"))), F.when(host.startswith("blog."), F.array(F.lit("!*.html"))).otherwise(F.array(F.lit(""))))
    each = F.array(row(F.lit(""), F.array(F.lit("*.html"), F.lit("/spam-farm.example.org/"))), row(host, at_host), row(lang, F.array(F.lit("/5*"), F.lit("!/6*"))))
    files = p.select("folder_id", F.inline(each)).distinct().select("folder_id", "dir", F.posexplode("lines").alias("line_no", "line"))
    out = rules.ignored_by_files(p, rules.rule_files(files), few_bytes=few_bytes)
    return out.select("page_id", "path", "rule.dir", "rule.pattern", "ignored")


@query(f"WITH {_RULE_FILES}")
def compose_rules(spark, sf_dir):
    """Verdicts by a tree's rule files, sent to every task since they are small."""
    return _by_rule_files(spark, sf_dir, rules.FEW_BYTES)


@query(f"WITH {_RULE_FILES}")
def rules_by_directory(spark, sf_dir):
    """The same where rule files are too many for that: paths dealt to the files above them."""
    return _by_rule_files(spark, sf_dir, 0)


@query(f"WITH {_G}, d AS (SELECT DISTINCT folder_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir FROM v WHERE page_id % 5 = 0) SELECT page_id FROM v WHERE EXISTS (SELECT 1 FROM d WHERE d.folder_id = v.folder_id AND (v.path = dir OR starts_with(v.path, dir || '/')))")
def under_prefix(spark, sf_dir):
    p = fx.pages(spark, sf_dir)
    return scan.under_prefix(p, _dirs(p)).select("page_id")


@query(f"WITH {_G}, d AS (SELECT DISTINCT folder_id, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS dir FROM v WHERE page_id % 5 = 0) SELECT page_id FROM v WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.folder_id = v.folder_id AND (v.path = dir OR starts_with(v.path, dir || '/')))")
def outside_nested_roots(spark, sf_dir):
    p = fx.pages(spark, sf_dir)
    return scan.outside_nested_roots(p, _dirs(p)).select("page_id")


def _dirs(p):
    return p.where("page_id % 5 = 0").select("folder_id", F.concat_ws("/", F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2))).alias("dir")).distinct()


_M1 = fx.duck(f"l AS ({fx.M1_LOCAL}), r AS ({fx.M1_REMOTE})")


@query(f"WITH {_M1} SELECT r.folder_id, r.path, l.size = r.size AND l.mtime = r.mtime AS unchanged FROM r JOIN l USING (folder_id, path)")
def unchanged(spark, sf_dir):
    l, r = fx.manifest(spark, sf_dir), fx.manifest(spark, sf_dir, True)
    j = r.join(l.select(*KEYS, F.col("size").alias("s"), F.col("mtime").alias("t")), KEYS)
    return j.select(*KEYS, scan.unchanged(F.col("s"), F.col("t"), F.col("size"), F.col("mtime")).alias("unchanged"))


@query(f"""WITH {_M1} SELECT r.folder_id, r.path, CASE WHEN l.path IS NULL THEN 'new' WHEN l.size <> r.size THEN 'changed' WHEN l.mtime = r.mtime THEN 'same' WHEN l.b0 = r.b0 THEN 'touched' ELSE 'changed' END AS change
FROM r LEFT JOIN (SELECT * FROM l WHERE NOT deleted) l ON l.folder_id = r.folder_id AND l.path = r.path WHERE NOT r.deleted""")
def scan_diff(spark, sf_dir):
    disk = fx.manifest(spark, sf_dir, True).where("not deleted")
    return scan.scan_diff(fx.manifest(spark, sf_dir), disk, disk).select(*KEYS, "change")


@query(f"WITH {_M1} SELECT l.folder_id, l.path, l.va + 1 AS va, l.vb, true AS deleted FROM l ANTI JOIN r USING (folder_id, path) WHERE NOT l.deleted")
def tombstones(spark, sf_dir):
    out = scan.tombstones(fx.manifest(spark, sf_dir), fx.manifest(spark, sf_dir, True), "A")
    return out.select(*KEYS, F.element_at("version", "A").alias("va"), F.element_at("version", "B").alias("vb"), "deleted")


@query(f"WITH {_M1} SELECT folder_id, path, size FROM l WHERE NOT deleted AND size % 3 = 0")
def placeholders(spark, sf_dir):
    m = fx.manifest(spark, sf_dir).withColumn("placeholder", F.expr("size % 3 = 0"))
    return scan.placeholders(m).select(*KEYS, "size")


_FOLDERS = "SELECT CAST(c_custkey AS STRING) AS folder_id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_nationkey END AS dev, c_custkey % 100 AS ino FROM {customer}"
_RECORDED = "SELECT CAST(c_custkey AS STRING) AS folder_id, c_nationkey + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS dev, c_custkey % 100 + CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS ino FROM {customer} WHERE c_custkey % 7 <> 0"


@query(fx.duck(f"""WITH a AS ({_FOLDERS}), b AS ({_RECORDED}) SELECT a.folder_id, CASE WHEN a.dev IS NULL THEN 'missing' WHEN b.ino IS NULL THEN 'unknown' WHEN a.ino <> b.ino THEN 'changed' WHEN a.dev = b.dev THEN 'ok'
 WHEN a.dev % 2 = 0 THEN 'remounted-known' ELSE 'remounted' END AS verdict FROM a LEFT JOIN b USING (folder_id)"""))
def identity_verdict(spark, sf_dir):
    known = F.array(*[F.lit(i) for i in range(0, 100, 2)])
    return scan.identity_verdict(fx.spark_sql(spark, sf_dir, _FOLDERS), fx.spark_sql(spark, sf_dir, _RECORDED).withColumn("known_devs", known))


@query(f"WITH {_M1} SELECT folder_id, path, CASE WHEN folder_id = 'f3' THEN 'no file seen in an unknown folder' END AS reason FROM l WHERE NOT deleted")
def mass_delete_guard(spark, sf_dir):
    m = fx.manifest(spark, sf_dir).where("not deleted")
    seen = fx.manifest(spark, sf_dir).where("folder_id not in ('f3', 'f4')")
    identity = m.select("folder_id").distinct().withColumn("verdict", F.when(F.col("folder_id") == "f3", "unknown").otherwise("ok"))
    ok, refused = scan.mass_delete_guard(m, seen, identity)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(refused).select(*KEYS, "reason")


_COPY = "regexp_replace(path, '\\.bin$', '') || '.sync-conflict-k' || CAST(size AS STRING) || '-ABCDEFGHI' || CASE WHEN size % 2 = 0 THEN 'A' ELSE 'B' END || '.bin'"


def _copies(spark, sf_dir):
    m = fx.manifest(spark, sf_dir).where("not deleted and size % 4 = 0")
    copies = m.withColumn("path", F.expr(_COPY.replace("\\", "\\\\")))
    return m, copies


@query(f"""WITH {_M1}, c AS (SELECT folder_id, {_COPY} AS path, path AS original_path, 'ABCDEFGHI' || CASE WHEN size % 2 = 0 THEN 'A' ELSE 'B' END AS device_id, mtime FROM l WHERE NOT deleted AND size % 4 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY mtime DESC, path) AS i, count(*) OVER (PARTITION BY folder_id) > 500 AS truncated FROM c) SELECT folder_id, path, original_path, device_id, truncated FROM n WHERE i <= 500""")
def conflict_copies(spark, sf_dir):
    """The newest 500 copies of each folder: the cap is the feature."""
    _, copies = _copies(spark, sf_dir)
    return scan.conflict_copies(copies).select(*KEYS, "original_path", "device_id", "truncated")


@query(f"WITH {_M1} SELECT folder_id, count(*) AS n FROM l WHERE NOT deleted AND size % 4 = 0 GROUP BY folder_id")
def conflict_counts(spark, sf_dir):
    return scan.conflict_counts(scan.conflict_copies(_copies(spark, sf_dir)[1], 1 << 30))


_IDENTICAL = f"c AS (SELECT folder_id, {_COPY} AS path, CASE WHEN size % 3 = 0 THEN NULL ELSE size % 5 <> 0 END AS identical FROM l WHERE NOT deleted AND size % 4 = 0)"


def _checked(spark, sf_dir):
    m, copies = _copies(spark, sf_dir)
    content = m.where("size % 3 <> 0").select(*KEYS, "size", F.lit("x").alias("sha256")).unionByName(copies.select(*KEYS, "size", F.expr("if(size % 5 = 0, 'y', 'x')").alias("sha256")))
    return scan.conflict_identical(scan.conflict_copies(copies, 1 << 30), content)


@query(f"WITH {_M1}, {_IDENTICAL} SELECT * FROM c")
def conflict_identical(spark, sf_dir):
    return _checked(spark, sf_dir).select(*KEYS, "identical")


@query(f"WITH {_M1}, {_IDENTICAL} SELECT folder_id, count(*) AS cleaned FROM c WHERE identical GROUP BY folder_id")
def clean_identical(spark, sf_dir):
    return scan.clean_identical(_checked(spark, sf_dir))


@query(f"""WITH {_G}, d AS (SELECT DISTINCT folder_id, split_part(path, '/', 1) AS path FROM v UNION SELECT DISTINCT folder_id, split_part(path, '/', 1) || '/empty' || page_id % 4 AS path FROM v)
SELECT folder_id, path, count(*) OVER (PARTITION BY folder_id) > 2000 AS truncated FROM d WHERE path LIKE '%/empty%' AND path NOT LIKE '%.example.org/%' AND NOT regexp_matches(path, '^blog[^/]*(/.*)?$') QUALIFY row_number() OVER (PARTITION BY folder_id ORDER BY path) <= 2000""")
def empty_dirs(spark, sf_dir):
    p = fx.pages(spark, sf_dir)
    top = F.split_part("path", F.lit("/"), F.lit(1))
    dirs = p.select("folder_id", top.alias("path")).union(p.select("folder_id", F.concat(top, F.lit("/empty"), F.expr("page_id % 4").cast("string")))).distinct()
    files = p.where(F.instr("path", "/") > 0)
    return scan.empty_dirs(dirs.where(F.col("path").contains("/")).unionByName(files.select("folder_id", top.alias("path")).distinct()), files, RULES)


@query(f"""WITH {_G}, c AS (SELECT folder_id, split_part(path, '/', 1) AS name, bool_or(contains(path, '/')) AS is_dir FROM v GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY is_dir DESC, name) AS i, count(*) OVER (PARTITION BY folder_id) > 2000 AS truncated FROM c) SELECT folder_id, name, is_dir, truncated FROM n WHERE i <= 2000""")
def list_directory(spark, sf_dir):
    """Children of each folder's root, up to the listing's cap of 2000."""
    p = fx.pages(spark, sf_dir).select(*KEYS, F.lit(1).alias("size"), F.lit(1).alias("mtime"))
    return scan.list_directory(p, "").select("folder_id", "name", "is_dir", "truncated")


def _archive(spark, sf_dir):
    e = fx.events(spark, sf_dir).withColumn("ms", F.unix_millis("ts"))
    stamp = F.lower(F.conv(F.col("ms").cast("string"), 10, 36))
    versions = e.where("action = 'update'").select(*KEYS, F.concat("path", F.lit(".tidemark-v-"), stamp).alias("file"), F.col("ms").alias("ts"))
    trash = e.where("action = 'delete'").select(*KEYS, F.concat("path", F.lit("."), stamp).alias("file"), F.col("ms").alias("ts"))
    last = e.groupBy(*KEYS).agg(F.max_by("action", F.struct("ms", "seq")).alias("a"), F.max("ms").alias("mtime"))
    current = last.where("a <> 'delete'").select(*KEYS, "mtime")
    return versions, trash, e.select(*KEYS, F.col("ms").alias("ts"), "action", "seq"), current


_E = fx.EVENTS + ", h AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM e)"


@query(f"WITH {_E} SELECT folder_id, path, arg_min(ms, ms) AS ts FROM h GROUP BY ALL")
def first_event(spark, sf_dir):
    return rollback.first_event(_archive(spark, sf_dir)[2]).select(*KEYS, "ts")


@query(f"WITH {_E} SELECT folder_id, path, min(ms) FILTER (ms > {fx.TARGET}) AS after_ts, max(ms) FILTER (ms <= {fx.TARGET}) AS before_ts FROM h WHERE action = 'update' GROUP BY ALL")
def nearest_versions(spark, sf_dir):
    out = rollback.nearest_versions(_archive(spark, sf_dir)[0], fx.TARGET)
    return out.select(*KEYS, F.col("after.ts").alias("after_ts"), F.col("before.ts").alias("before_ts"))


_ROLLBACK = f"""{_E}, k AS (SELECT folder_id, path, min(ms) FILTER (action = 'update' AND ms > {fx.TARGET}) AS after_ts, max(ms) FILTER (action = 'update' AND ms <= {fx.TARGET}) AS before_ts,
 count(*) FILTER (action = 'delete') AS trashed, arg_min(action, ms) AS first_action, min(ms) AS first_ts, coalesce(bool_or(action = 'delete' AND ms > {fx.TARGET}), false) AS deleted_later,
 CASE WHEN arg_max(action, (ms, seq)) <> 'delete' THEN max(ms) END AS now FROM h GROUP BY ALL),
o AS (SELECT *, coalesce(after_ts, before_ts) AS best FROM k),
plan AS (SELECT folder_id, path, CASE WHEN now IS NOT NULL AND first_action = 'add' AND first_ts > {fx.TARGET} AND best IS NULL THEN 'trash-current' WHEN now IS NOT NULL AND best IS NOT NULL AND (now > {fx.TARGET} OR after_ts IS NOT NULL) THEN 'restore'
 WHEN now > {fx.TARGET} AND best IS NULL THEN 'no-snapshot' WHEN now IS NOT NULL THEN NULL WHEN best IS NOT NULL THEN 'restore' WHEN deleted_later AND trashed > 0 THEN 'from-trash' WHEN deleted_later THEN 'lost-delete' END AS outcome, best FROM o)"""


@query(f"WITH {_ROLLBACK} SELECT folder_id, path, outcome, CASE WHEN outcome = 'restore' THEN best END AS ts FROM plan WHERE outcome IS NOT NULL")
def rollback_plan(spark, sf_dir):
    return rollback.rollback_plan(*_archive(spark, sf_dir), fx.TARGET).select(*KEYS, "outcome", "ts")


@query(f"WITH {_ROLLBACK} SELECT folder_id, outcome, count(*) AS n FROM plan WHERE outcome IS NOT NULL GROUP BY ALL")
def rollback_counts(spark, sf_dir):
    return rollback.rollback_counts(rollback.rollback_plan(*_archive(spark, sf_dir), fx.TARGET))


@query(f"WITH {_E}, n AS (SELECT folder_id, path, ms AS ts, row_number() OVER (PARTITION BY folder_id, path ORDER BY ms DESC) AS i FROM h WHERE action = 'update') SELECT folder_id, path, ts FROM n WHERE i > 10")
def version_retention(spark, sf_dir):
    return rollback.version_retention(_archive(spark, sf_dir)[0]).select(*KEYS, "ts")


@query(f"WITH {_E} SELECT folder_id, path, count(*) AS n, max(ms) AS latest FROM h WHERE action = 'update' GROUP BY ALL")
def version_groups(spark, sf_dir):
    return rollback.version_groups(_archive(spark, sf_dir)[0]).select(*KEYS, "n", "latest")


@query(f"WITH {_E} SELECT folder_id, path, ms AS ts FROM h WHERE action = 'update'")
def read_version_archive(spark, sf_dir):
    v = _archive(spark, sf_dir)[0]
    return sources.parse_version_names(v.select("folder_id", F.col("file").alias("path"))).select(*KEYS, "ts")


@query(f"WITH {_E} SELECT folder_id, path, ms AS ts FROM h WHERE action = 'delete'")
def read_trash_archive(spark, sf_dir):
    v, t, _, _ = _archive(spark, sf_dir)
    both = v.select("folder_id", F.col("file").alias("path"), F.lit(1).alias("size")).unionByName(t.select("folder_id", F.col("file").alias("path"), F.lit(1).alias("size")))
    return sources.parse_trash_names(both).where(~F.col("path").contains("-v-")).select(*KEYS, "ts")


def _written_tree(spark, sf_dir):
    """Documents as lines of text files, a directory for each source and language."""
    base = f"{shared_dir(spark).rstrip('/')}/tree/{uuid.uuid4().hex}"
    fx.table(spark, sf_dir, "documents").select("source", "lang", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source", "lang").text(base)
    return base


@query("SELECT 'source=' || source || '/lang=' || lang AS directory, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size FROM documents GROUP BY ALL")
def scan_files(spark, sf_dir):
    """A written tree, listed without opening a file."""
    listed = sources.scan_files(spark, _written_tree(spark, sf_dir), "data", glob="*.txt")
    return listed.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.sum("size").alias("size"))


@query("""WITH d AS (SELECT DISTINCT 'source=' || source AS s, 'lang=' || lang AS l FROM documents), k AS (SELECT s, l FROM d WHERE s <> 'source=src3')
SELECT '' AS directory UNION SELECT s FROM k UNION SELECT s || '/' || l FROM k WHERE l <> 'lang=de' OR s = 'source=src5'""")
def walked_directories(spark, sf_dir):
    """The directories that a walk lists: not those of another folder's root inside, nor ignored ones, nor what is below."""
    nested = spark.createDataFrame([("data", "source=src3"), ("other", "source=src4")], "folder_id string, dir string")
    rules_ = ignore.parse_rules(["lang=de/", "!source=src5/lang=de/"])
    _, dirs = tree.walk(spark, _written_tree(spark, sf_dir), "data", rules_, nested, "*.txt")
    return dirs.select(F.col("path").alias("directory"))


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS n FROM documents)
SELECT CASE doc_id % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'touched' WHEN 2 THEN 'changed' WHEN 3 THEN 'changed' ELSE 'new' END AS change, doc_id % 5 IN (1, 2) AS opened, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM d GROUP BY ALL""")
def scan_diff_by_content(spark, sf_dir):
    """A file for each document against a manifest with other times, hashes, sizes or no row: only doubtful files are opened."""
    base = f"{shared_dir(spark).rstrip('/')}/tree/{uuid.uuid4().hex}"
    path = F.concat_ws("/", F.pmod("doc_id", F.lit(1024)).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    content = fx.table(spark, sf_dir, "documents").select(F.lit("data").alias("folder_id"), path.alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content"))
    tree.write_files(content, {"data": base})
    listing = sources.scan_files(spark, base, "data", glob="*.txt")
    listing = listing.withColumn("id", F.regexp_extract("path", r"/(-?\d+)\.txt$", 1).cast("bigint"))
    blocks = chunking._lists(chunking.fixed_blocks(content, 4096), "blocks")
    known = listing.where("id % 5 <> 4").join(blocks, KEYS)
    off = lambda k, other, c: F.when(F.col("id") % 5 == k, other).otherwise(c)
    manifest = known.select(*KEYS, off(3, F.col("size") + 1, F.col("size")).alias("size"), F.when(F.col("id") % 5 == 0, F.col("mtime")).otherwise(F.col("mtime") - 5000).alias("mtime"), off(2, F.array(F.lit("x")), F.col("blocks")).alias("blocks"))
    out = tree.settle_candidates(scan.scan_diff(manifest, listing, keep_blocks=True), {"data": base}, 4096)
    return out.groupBy("change", "opened").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: Extensions that pages' paths get in turn: what each must be taken for, and up to how many MiB it is compared.
_EXTENSIONS = (("png", "image", 8), ("JPEG", "image", 8), ("md", "text", 2), ("ts", "code", 2), ("tar", "archive", 2), ("mp4", "media", 2), ("pdf", "document", 2), ("unknownx", "other", 2), ("", "other", 2))
_CASE = "CASE page_id % 9 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(9)) + " END"
_of = lambda f: _CASE.format(*[f(*x) for x in _EXTENSIONS])


@query(f"WITH {fx.PAGES} SELECT page_id, lower({_of(lambda e, k, n: repr(e))}) AS extension, {_of(lambda e, k, n: repr(k))} AS kind, CAST(1048576 * {_of(lambda e, k, n: n)} AS BIGINT) AS compare_limit FROM g")
def file_kind(spark, sf_dir):
    """Files beside the pages, with extensions of every kind, in capitals and without one."""
    name = F.concat("path", F.lit("/.hidden/x"), F.expr(_of(lambda e, k, n: repr(f".{e}" if e else ""))))
    p = fx.pages(spark, sf_dir).select("page_id", name.alias("path"))
    return p.select("page_id", scalars.extension("path").alias("extension"), scalars.file_kind("path").alias("kind"), scalars.compare_limit("path").alias("compare_limit"))
