"""Convergence of two sides' manifests: plans, conflict outcomes and the manifest after them.

A manifest has folder_id, path (its key), version, size, deleted, blocks and optionally cdh,
clens, mtime, placeholder. All joins are equi-joins on (folder_id, path), one exchange a side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ignore import Rule, hard_ignored, ignored, ignored_path
from tidemark.functions.vectors import compare_file_state, merge_versions
from tidemark.operators.common import KEYS, MANIFEST, as_manifest, side

ACTIONS = ("send", "receive", "delete", "conflict")


def _action() -> Column:
    l, r = F.col("local"), F.col("remote")
    state = compare_file_state(l.isNotNull(), r.isNotNull(), l["version"], r["version"])
    gone = lambda x, live: F.when(x["deleted"], "delete").otherwise(live)
    return F.when(state == "local-newer", gone(l, "send")).when(state == "remote-newer", gone(r, "receive")).when(state == "conflict", "conflict")


def joined(local: DataFrame, remote: DataFrame, how: str) -> DataFrame:
    """(folder_id, path, local, remote) with each side's row as a struct."""
    return side(local, "local").join(side(remote, "remote"), KEYS, how)


def plan_full(local: DataFrame, remote: DataFrame) -> DataFrame:
    """(folder_id, path, action, local, remote) over both sides' paths; equal pairs give no row.

    For whole indexes only: what the remote doesn't name, it lacks.
    """
    return joined(local, remote, "full_outer").withColumn("action", _action()).where("action is not null")


def plan_delta(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The plan of a delta: only paths that the remote names, so nothing else is sent."""
    return side(remote, "remote").join(side(local, "local"), KEYS, "left").withColumn("action", _action()).where("action is not null")


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("folder_id", "action").agg(F.count("*").alias("n"))


def exportable_entries(rules: list[Rule], entries: DataFrame) -> DataFrame:
    """Rows to show to others: no hard-ignored ones, of ignored ones only tombstones."""
    return entries.where(~hard_ignored("path") & (F.col("deleted") | ~ignored(rules, "path")))


def inbound_entries(rules: list[Rule], entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows let in, hard-ignored rows to report); ignored rows go silently, tombstones too."""
    hard = hard_ignored("path")
    return entries.where(~ignored_path(rules, "path")), entries.where(hard)


def minus_paused(actions: DataFrame, paused: DataFrame) -> DataFrame:
    """Rows whose (folder_id, path) isn't paused."""
    return actions.join(paused.select(*KEYS), KEYS, "left_anti")


def resolve_conflicts(plan: DataFrame, device: str, policies: DataFrame | None = None, receive_only: Column | bool = False, relayed: Column | bool = False) -> DataFrame:
    """Conflict rows of a plan with `outcome`: take-remote, merge-only, keep-local or keep-both.

    policies: (folder_id, policy) with keep-both, local-wins or newest-wins. In order: a
    receiving folder, or a relayed delta that no local edit of `device` meets, takes the
    remote; live rows of the same blocks only merge; then the folder's policy; newest-wins
    without both times, or with equal ones, keeps both.
    """
    rows = _with_policies(plan.where("action = 'conflict'"), policies)
    return rows.withColumn("outcome", _outcome(device, receive_only, relayed))


def _with_policies(rows: DataFrame, policies: DataFrame | None) -> DataFrame:
    if policies is None:
        return rows.withColumn("policy", F.lit("keep-both"))
    return rows.join(policies.select("folder_id", "policy"), "folder_id", "left").fillna({"policy": "keep-both"})


def _outcome(device: str, receive_only: Column | bool, relayed: Column | bool) -> Column:
    """Of a conflict's row (local, remote, policy)."""
    l, r = F.col("local"), F.col("remote")
    flag = lambda x: F.lit(x) if isinstance(x, bool) else x
    edited = F.coalesce(F.try_element_at(l["version"], F.lit(device)), F.lit(0)) > 0
    live = ~l["deleted"] & ~r["deleted"]
    same = live & ~F.coalesce(l["placeholder"], F.lit(False)) & (l["blocks"] == r["blocks"])
    newest = live & (F.col("policy") == "newest-wins")
    return (
        F.when(flag(receive_only) | (flag(relayed) & ~edited), "take-remote")
        .when(same, "merge-only")
        .when(live & (F.col("policy") == "local-wins"), "keep-local")
        .when(newest & (r["mtime"] > l["mtime"]), "take-remote")
        .when(newest & (l["mtime"] > r["mtime"]), "keep-local")
        .otherwise("keep-both")
    )


def apply_plan(local: DataFrame, plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The local manifest after a plan and its conflicts' outcomes.

    Received rows and remote deletions are the remote's; a kept-both conflict lands the
    remote with the merged vector (its local copy is a file of its own, not an index row);
    the other outcomes keep the local row with the merged vector. Sends change nothing here.
    Where plan and outcomes are still to be made, converged() does all three in one join.
    """
    o = outcomes.select(*KEYS, "outcome")
    step = plan.select(*KEYS, "action", "remote").join(o, KEYS, "left")
    return _landed(side(local, "local").join(step, KEYS, "full_outer"))


def converged(local: DataFrame, remote: DataFrame, device: str, policies: DataFrame | None = None, receive_only: Column | bool = False, relayed: Column | bool = False) -> DataFrame:
    """The local manifest after plan_full, resolve_conflicts and apply_plan: one exchange a side."""
    rows = _with_policies(joined(local, remote, "full_outer").withColumn("action", _action()), policies)
    return _landed(rows.withColumn("outcome", F.when(F.col("action") == "conflict", _outcome(device, receive_only, relayed))))


def _landed(rows: DataFrame) -> DataFrame:
    """(folder_id, path, *manifest) of rows (local, remote, action, outcome)."""
    l, r = F.col("local"), F.col("remote")
    newer = compare_file_state(l.isNotNull(), r.isNotNull(), l["version"], r["version"]) == "remote-newer"
    takes = F.coalesce(F.col("action").isin("receive", "delete") & newer, F.lit(False)) | F.coalesce(F.col("outcome") == "take-remote", F.lit(False))
    conflict = F.coalesce(F.col("action") == "conflict", F.lit(False)) & ~takes
    both = F.coalesce(F.col("outcome") == "keep-both", F.lit(False))
    chosen = F.when(takes | (conflict & both), r).otherwise(l)
    version = F.when(conflict, merge_versions(l["version"], r["version"])).when(takes, r["version"]).otherwise(l["version"])
    out = rows.select(*KEYS, chosen.alias("e"), version.alias("version"))
    return out.select(*KEYS, "version", *[F.col(f"e.{c}").alias(c) for c in ("size", "deleted", "blocks", "cdh", "clens", "mtime", "placeholder")])


def transfer_estimate(plan: DataFrame, held: DataFrame | None = None, on_demand: Column | bool = False) -> DataFrame:
    """(folder_id, needed): bytes that receive and conflict actions will take.

    max(0, new size - live current size - bytes already held); received rows of on-demand
    paths become placeholders and take none. held: (folder_id, path, held).
    """
    p = plan.where(F.col("action").isin("receive", "conflict"))
    p = p.withColumn("held", F.lit(0)) if held is None else p.join(held.select(*KEYS, "held"), KEYS, "left")
    current = F.when(F.col("local").isNotNull() & ~F.col("local.deleted"), F.col("local.size")).otherwise(0)
    later = (F.col("action") == "receive") & (F.size("remote.blocks") > 0) & (F.lit(on_demand) if isinstance(on_demand, bool) else on_demand)
    need = F.when(later, 0).otherwise(F.greatest(F.lit(0), F.col("remote.size") - current - F.coalesce("held", F.lit(0))))
    return p.groupBy("folder_id").agg(F.sum(need).cast("bigint").alias("needed"))


def fan_out(deltas: DataFrame, members: DataFrame) -> DataFrame:
    """deltas (folder_id, source_device, ...) with each other connected device of the folder, once."""
    m = members.select("folder_id", F.col("device_id").alias("recipient")).distinct()
    return deltas.join(m, "folder_id").where(~F.col("recipient").eqNullSafe(F.col("source_device")))


def all_paths(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select(*KEYS).union(remote.select(*KEYS)).distinct()


def only_local(local: DataFrame, remote: DataFrame) -> DataFrame:
    return local.select(*KEYS).join(remote.select(*KEYS), KEYS, "left_anti")


def only_remote(local: DataFrame, remote: DataFrame) -> DataFrame:
    return only_local(remote, local)


def upsert_manifest(manifest: DataFrame, updates: DataFrame, *more: str) -> DataFrame:
    """manifest with each key's latest update (by seq) in place of its row; more: further columns of both."""
    cols = [*MANIFEST, *more]
    u = as_manifest(updates, "seq", *more).groupBy(*KEYS).agg(F.max_by(F.struct(*cols), "seq").alias("u"))
    m = as_manifest(manifest, *more).select(*KEYS, F.struct(*cols).alias("m"))
    return m.join(u, KEYS, "full_outer").select(*KEYS, F.coalesce("u", "m").alias("e")).select(*KEYS, "e.*")
