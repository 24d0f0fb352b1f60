"""Queries: plans, diffs, conflicts, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ignore, scalars, vectors
from tidemark.operators import diff, drift, plan
from tidemark.operators.common import KEYS
from tidemark.plans import fixtures as fx
from tidemark.plans.queries import query

RULES = ignore.parse_rules(["c1*/", "!c12/", "*99.bin"])
REMOTE_RULES = ignore.parse_rules(["*5.bin"])
#: DuckDB: the local rule that ignores path, and the remote one.
_LOCAL_RULE = "CASE WHEN path LIKE '%99.bin' THEN '*99.bin' WHEN path LIKE 'c12/%' THEN NULL WHEN path LIKE 'c1%/%' THEN 'c1*/' END"
_REMOTE_RULE = "CASE WHEN path LIKE '%5.bin' THEN '*5.bin' END"
_DIFF = f"""{fx.PLAN},
d AS (SELECT *, {_LOCAL_RULE} AS mine, {_REMOTE_RULE} AS theirs FROM s),
k AS (SELECT *, CASE WHEN NOT lt THEN CASE WHEN rdel THEN 'in-sync' WHEN mine IS NOT NULL THEN 'ignored-locally' ELSE 'remote-newer' END
                     WHEN NOT rt THEN CASE WHEN ldel THEN 'in-sync' WHEN theirs IS NOT NULL THEN 'ignored-remotely' ELSE 'local-newer' END
                     WHEN state = 'equal' THEN CASE WHEN ldel = rdel AND (ldel OR (lsize = rsize AND lb = rb)) THEN 'in-sync' ELSE 'content-mismatch' END
                     ELSE state END AS kind FROM d),
o AS (SELECT *, CAST(list_position(['content-mismatch', 'conflict', 'local-newer', 'remote-newer', 'ignored-locally', 'ignored-remotely', 'in-sync'], kind) - 1 AS INTEGER) AS severity,
             CASE kind WHEN 'ignored-locally' THEN mine WHEN 'ignored-remotely' THEN theirs END AS rule FROM k)"""


def _sides(spark, sf_dir):
    return fx.manifest(spark, sf_dir), fx.manifest(spark, sf_dir, True)


def _ab(df, version="version"):
    """Vector columns as two numbers."""
    at = lambda d: F.coalesce(F.try_element_at(F.col(version), F.lit(d)), F.lit(0))
    return df.withColumns({"va": at("A"), "vb": at("B")})


@query(f"WITH {fx.PLAN} SELECT folder_id, path, action FROM p WHERE action IS NOT NULL")
def plan_full(spark, sf_dir):
    return plan.plan_full(*_sides(spark, sf_dir)).select(*KEYS, "action")


@query(f"WITH {fx.PLAN} SELECT folder_id, path, action FROM p WHERE action IS NOT NULL AND rt")
def plan_delta(spark, sf_dir):
    return plan.plan_delta(*_sides(spark, sf_dir)).select(*KEYS, "action")


@query(f"WITH {fx.PLAN} SELECT folder_id, action, count(*) AS n FROM p WHERE action IS NOT NULL GROUP BY ALL")
def plan_counts(spark, sf_dir):
    return plan.plan_counts(plan.plan_full(*_sides(spark, sf_dir)))


@query(f"WITH {fx.PLAN} SELECT folder_id, path FROM j")
def all_paths(spark, sf_dir):
    return plan.all_paths(*_sides(spark, sf_dir))


@query(f"WITH {fx.PLAN} SELECT folder_id, path FROM j WHERE NOT rt")
def only_local(spark, sf_dir):
    return plan.only_local(*_sides(spark, sf_dir))


@query(f"WITH {fx.PLAN} SELECT folder_id, path FROM j WHERE NOT lt")
def only_remote(spark, sf_dir):
    return plan.only_remote(*_sides(spark, sf_dir))


@query(f"WITH {fx.PLAN} SELECT folder_id, path, state FROM s")
def compare_file_state(spark, sf_dir):
    j = plan.joined(*_sides(spark, sf_dir), "full_outer")
    state = vectors.compare_file_state(F.col("local").isNotNull(), F.col("remote").isNotNull(), "local.version", "remote.version")
    return j.select(*KEYS, state.alias("state"))


@query(f"""WITH {fx.PLAN} SELECT folder_id, path, CASE WHEN lva = rva AND lvb = rvb THEN 'equal' WHEN lva >= rva AND lvb >= rvb THEN 'a-newer'
 WHEN lva <= rva AND lvb <= rvb THEN 'b-newer' ELSE 'concurrent' END AS relation, lva = rva AND lvb = rvb AS same, greatest(lva, rva) AS va, greatest(lvb, rvb) AS vb, lva + 1 AS next_a FROM j WHERE lt AND rt""")
def compare_versions(spark, sf_dir):
    """compare_versions, vectors_equal, merge_versions and increment_version of pairs."""
    j = plan.joined(*_sides(spark, sf_dir), "inner")
    j = j.withColumns({"relation": vectors.compare_versions("local.version", "remote.version"), "same": vectors.vectors_equal("local.version", "remote.version"), "m": vectors.merge_versions("local.version", "remote.version")})
    j = j.withColumn("next_a", F.element_at(vectors.increment_version("local.version", "A"), "A"))
    return _ab(j, "m").select(*KEYS, "relation", "same", "va", "vb", "next_a")


@query(f"WITH {fx.PLAN}, u AS (SELECT folder_id, va, vb FROM l UNION ALL SELECT folder_id, va, vb FROM r) SELECT folder_id, max(va) AS va, max(vb) AS vb FROM u GROUP BY ALL")
def merge_vectors(spark, sf_dir):
    l, r = _sides(spark, sf_dir)
    return _ab(vectors.merge_groups(l.unionByName(r), ["folder_id"])).drop("version")


@query(f"""WITH {fx.PLAN}, c AS (SELECT *, CASE folder_id WHEN 'f1' THEN 'local-wins' WHEN 'f2' THEN 'newest-wins' WHEN 'f5' THEN 'newest-wins' ELSE 'keep-both' END AS policy, NOT ldel AND NOT rdel AS live FROM p WHERE action = 'conflict')
SELECT folder_id, path, CASE WHEN folder_id = 'f7' THEN 'take-remote' WHEN folder_id = 'f6' AND lva = 0 THEN 'take-remote' WHEN live AND lb = rb THEN 'merge-only'
 WHEN live AND policy = 'local-wins' THEN 'keep-local' WHEN live AND policy = 'newest-wins' AND rm > lm THEN 'take-remote' WHEN live AND policy = 'newest-wins' AND lm > rm THEN 'keep-local' ELSE 'keep-both' END AS outcome FROM c""")
def resolve_conflicts(spark, sf_dir):
    return plan.resolve_conflicts(plan.plan_full(*_sides(spark, sf_dir)), *_rules(spark, sf_dir)).select(*KEYS, "outcome")


_POLICIES = "SELECT DISTINCT 'f' || CAST(o_custkey % 8 AS STRING) AS folder_id, CASE o_custkey % 8 WHEN 1 THEN 'local-wins' WHEN 2 THEN 'newest-wins' WHEN 5 THEN 'newest-wins' ELSE 'keep-both' END AS policy FROM {orders}"


def _rules(spark, sf_dir):
    """Device, policies, folders that only receive, folders whose deltas are relayed."""
    return "A", fx.spark_sql(spark, sf_dir, _POLICIES), F.col("folder_id") == "f7", F.col("folder_id") == "f6"


@query(f"""WITH {fx.PLAN}, c AS (SELECT *, NOT ldel AND NOT rdel AS live FROM p),
x AS (SELECT *, CASE WHEN action <> 'conflict' OR action IS NULL THEN NULL WHEN folder_id = 'f7' OR (folder_id = 'f6' AND lva = 0) THEN 'take-remote' WHEN live AND lb = rb THEN 'merge-only'
 WHEN live AND folder_id = 'f1' THEN 'keep-local' WHEN live AND folder_id IN ('f2', 'f5') AND rm > lm THEN 'take-remote' WHEN live AND folder_id IN ('f2', 'f5') AND lm > rm THEN 'keep-local' ELSE 'keep-both' END AS outcome FROM c),
y AS (SELECT *, state = 'remote-newer' OR coalesce(outcome = 'take-remote', false) AS takes FROM x)
SELECT folder_id, path, CASE WHEN takes THEN rva WHEN state = 'conflict' THEN greatest(lva, rva) ELSE lva END AS va, CASE WHEN takes THEN rvb WHEN state = 'conflict' THEN greatest(lvb, rvb) ELSE lvb END AS vb,
 CASE WHEN takes OR coalesce(outcome = 'keep-both', false) THEN rsize ELSE lsize END AS size, CASE WHEN takes OR coalesce(outcome = 'keep-both', false) THEN rdel ELSE ldel END AS deleted FROM y""")
def apply_plan(spark, sf_dir):
    return _ab(plan.converged(*_sides(spark, sf_dir), *_rules(spark, sf_dir))).select(*KEYS, "va", "vb", "size", "deleted")


@query(f"WITH {fx.PLAN} SELECT folder_id, CAST(sum(greatest(0, rsize - CASE WHEN lt AND NOT ldel THEN lsize ELSE 0 END)) AS BIGINT) AS needed FROM p WHERE action IN ('receive', 'conflict') GROUP BY folder_id")
def transfer_estimate(spark, sf_dir):
    return plan.transfer_estimate(plan.plan_full(*_sides(spark, sf_dir)))


@query(fx.duck(f"WITH m AS ({fx.M7}), d AS (SELECT DISTINCT 'f' || CAST(o_custkey % 8 AS STRING) AS folder_id, 'd' || CAST(o_orderkey % 7 AS STRING) AS source_device FROM orders) SELECT d.folder_id, source_device, device_id AS recipient FROM d JOIN m ON d.folder_id = m.folder_id AND device_id <> source_device"))
def fan_out(spark, sf_dir):
    deltas = fx.spark_sql(spark, sf_dir, "SELECT DISTINCT 'f' || CAST(o_custkey % 8 AS STRING) AS folder_id, 'd' || CAST(o_orderkey % 7 AS STRING) AS source_device FROM {orders}")
    return plan.fan_out(deltas, fx.members(spark, sf_dir))


@query(f"WITH {fx.PLAN} SELECT p.folder_id, p.path, p.action FROM p WHERE action IS NOT NULL AND NOT (lt AND lva = 3 AND lvb = 1)")
def minus_paused(spark, sf_dir):
    l, r = _sides(spark, sf_dir)
    paused = _ab(l).where("va = 3 and vb = 1")
    return plan.minus_paused(plan.plan_full(l, r), paused).select(*KEYS, "action")


@query(f"WITH {fx.PLAN}, n AS (SELECT *, {_LOCAL_RULE} AS mine FROM l) SELECT folder_id, path, deleted FROM n WHERE deleted OR mine IS NULL")
def exportable_entries(spark, sf_dir):
    return plan.exportable_entries(RULES, fx.manifest(spark, sf_dir)).select(*KEYS, "deleted")


@query(f"WITH {fx.PLAN}, n AS (SELECT *, {_LOCAL_RULE} AS mine FROM r) SELECT folder_id, path, deleted FROM n WHERE mine IS NULL")
def inbound_entries(spark, sf_dir):
    return plan.inbound_entries(RULES, fx.manifest(spark, sf_dir, True))[0].select(*KEYS, "deleted")


@query(f"WITH {fx.PLAN} SELECT folder_id, path, size, deleted, CASE WHEN deleted THEN '' ELSE sha256(b0) END AS digest FROM l")
def to_snapshot(spark, sf_dir):
    return diff.to_snapshot(fx.manifest(spark, sf_dir)).select(*KEYS, "size", "deleted", "digest")


def _diff(spark, sf_dir):
    l, r = (diff.to_snapshot(m) for m in _sides(spark, sf_dir))
    return diff.folder_diff(l, r, RULES, REMOTE_RULES)


@query(f"WITH {_DIFF} SELECT folder_id, path, kind, severity, rule, false AS hard FROM o")
def folder_diff(spark, sf_dir):
    return _diff(spark, sf_dir).select(*KEYS, "kind", "severity", "rule", "hard")


@query(f"""WITH {_DIFF} SELECT folder_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k.replace('-', '_')}" for k in diff.KINDS)}, count(*) FILTER (kind <> 'in-sync') AS total FROM o GROUP BY folder_id""")
def diff_counts(spark, sf_dir):
    return diff.diff_counts(_diff(spark, sf_dir))


@query(f"WITH {_DIFF}, n AS (SELECT *, row_number() OVER (ORDER BY severity, path) AS place FROM o WHERE kind <> 'in-sync') SELECT CAST(place AS INTEGER) AS place, folder_id, path, kind FROM n WHERE place <= 500")
def diff_order(spark, sf_dir):
    """The 500 most severe differences, in order."""
    from pyspark.sql import Window

    top = diff.diff_items(_diff(spark, sf_dir)).limit(500)
    return top.select(F.row_number().over(Window.orderBy("severity", "path")).alias("place"), *KEYS, "kind")


@query(f"WITH {_DIFF} SELECT folder_id, path, CASE WHEN lt AND NOT ldel THEN CASE WHEN NOT rt THEN 'missing' WHEN rsize = lsize THEN 'ok' ELSE 'size-differs' END END AS disk FROM o")
def disk_check(spark, sf_dir):
    return diff.disk_check(_diff(spark, sf_dir), fx.manifest(spark, sf_dir, True)).select(*KEYS, "disk")


_TREE = f"""{fx.PLAN},
t AS (SELECT folder_id, path, CASE WHEN NOT rt THEN 'only-local' WHEN NOT lt THEN 'only-remote' WHEN ldel <> rdel THEN 'diff'
        WHEN lsize = rsize AND (ldel OR lb = rb) THEN 'same' ELSE 'diff' END AS status FROM j WHERE coalesce(NOT ldel, false) OR coalesce(NOT rdel, false)),
tree AS (SELECT folder_id, path, false AS is_dir, status FROM t UNION ALL
         SELECT folder_id, split_part(path, '/', 1) AS path, true AS is_dir, CASE WHEN bool_or(status <> 'same') THEN 'diff' ELSE 'same' END AS status FROM t GROUP BY 1, 2)"""


@query(f"WITH {_TREE} SELECT * FROM tree")
def compare_tree(spark, sf_dir):
    return diff.compare_tree(*(diff.to_snapshot(m) for m in _sides(spark, sf_dir)))


@query(f"WITH {_TREE} SELECT folder_id, status, count(*) AS n FROM tree GROUP BY ALL")
def tree_counts(spark, sf_dir):
    return diff.tree_counts(compare_tree(spark, sf_dir))


@query(f"""WITH {fx.PLAN}, h AS (SELECT folder_id, sha256(path || chr(0) || concat_ws(',', CASE WHEN va <> 0 THEN 'A=' || va END, CASE WHEN vb <> 0 THEN 'B=' || vb END) || chr(0) || size || chr(0) || CAST(deleted AS VARCHAR) || chr(0) || CASE WHEN deleted THEN '' ELSE b0 END || chr(0) || chr(0)) AS h FROM l)
SELECT folder_id, sha256(concat_ws(':', count(*), {', '.join(f"sum(CAST(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS UBIGINT) AS HUGEINT))" for i in range(4))})) AS fingerprint FROM h GROUP BY folder_id""")
def manifest_fingerprint(spark, sf_dir):
    return diff.manifest_fingerprint(fx.manifest(spark, sf_dir))


@query(f"WITH {fx.PLAN} SELECT DISTINCT folder_id FROM j WHERE NOT (lt AND rt AND lva = rva AND lvb = rvb AND lsize = rsize AND ldel = rdel AND (ldel OR lb = rb))")
def changed_folders(spark, sf_dir):
    return diff.changed_folders(*_sides(spark, sf_dir))


_PAIRS = f"{fx.PLAN}, q AS (SELECT * FROM s WHERE state = 'equal' AND NOT ldel AND NOT rdel)"
_DRIFT = f"""{_PAIRS}, z AS (SELECT folder_id, path, CASE WHEN lsize <> rsize THEN 'size' WHEN lb <> rb THEN 'content' END AS kind, CASE WHEN lsize = rsize AND lb <> rb THEN 0 END AS slot,
 CASE WHEN lsize <> rsize THEN CAST(lsize AS VARCHAR) ELSE lb END AS of_local, CASE WHEN lsize <> rsize THEN CAST(rsize AS VARCHAR) ELSE rb END AS of_remote FROM q)"""


@query(f"WITH {_PAIRS} SELECT folder_id, path FROM q")
def equal_pairs(spark, sf_dir):
    return drift.equal_pairs(*_sides(spark, sf_dir)).select(*KEYS)


@query(f"WITH {_DRIFT} SELECT folder_id, path, kind, CAST(slot AS INTEGER) AS slot, of_local, of_remote FROM z WHERE kind IS NOT NULL")
def declared_drift(spark, sf_dir):
    return drift.declared_drift(drift.equal_pairs(*_sides(spark, sf_dir)))


_SAMPLE = """n AS (SELECT *, row_number() OVER (PARTITION BY folder_id ORDER BY substr(md5(path), 1, 2), path) - 1 AS i, count(*) OVER (PARTITION BY folder_id) AS c FROM {rows}),
m AS (SELECT *, greatest(1, CAST(ceil(c / 20.0) AS BIGINT)) AS step FROM n), sample AS (SELECT * FROM m WHERE i % step = 3 % step)"""


@query(f"WITH {fx.PLAN}, {_SAMPLE.format(rows='l')} SELECT folder_id, path FROM sample")
def stride_sample(spark, sf_dir):
    """A round of the audit's sampling: the cap on its size is the feature."""
    return drift.stride_sample(fx.manifest(spark, sf_dir), 20, 3).select(*KEYS)


@query(f"WITH {fx.PLAN} SELECT folder_id, path, CAST(('0x' || substr(sha256(path || ':3'), 1, 8)) AS BIGINT) % 7 AS slot FROM l")
def pick_slot(spark, sf_dir):
    return fx.manifest(spark, sf_dir).select(*KEYS, scalars.pick_slot(F.concat("path", F.lit(":3")), F.lit(7)).alias("slot"))


@query(f"""WITH {_DRIFT}, {_SAMPLE.format(rows='z')} SELECT folder_id, count(*) AS candidates, (SELECT count(*) FROM sample x WHERE x.folder_id = z.folder_id) AS sampled,
 (SELECT count(*) FROM sample x WHERE x.folder_id = z.folder_id AND kind IS NOT NULL) AS declared, CAST(0 AS BIGINT) AS disk, CAST(0 AS BIGINT) AS unreadable FROM z GROUP BY folder_id""")
def audit_summary(spark, sf_dir):
    pairs = drift.equal_pairs(*_sides(spark, sf_dir))
    sampled = drift.stride_sample(pairs, 20, 3)
    return drift.audit_summary(pairs, sampled, drift.declared_drift(sampled))
